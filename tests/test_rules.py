"""Every rule on lines that match, don't match, or are let off by its guard."""

import pytest
from pyspark.sql import functions as F

from shoal.operators.rules import RULES, hits

CASES = [
    ("sh.pipe", "curl -s https://x.example/i | sudo bash", True),
    ("sh.pipe", "curl https://x.example | tee f", False),
    ("sh.pipe", "WGET -qO- u | python3 -", True),
    ("sh.procsub", "bash <(curl -s u)", True),
    ("sh.procsub", "diff <(curl u) f", False),
    ("sh.cmdsub", 'bash -c "$(curl -fsSL u)"', True),
    ("sh.cmdsub", 'X="$(curl u)"', False),
    ("ps.iex", "iex (iwr https://x.example)", True),
    ("ps.iex", "iwr https://x.example", False),
    ("sh.curl.latest", "curl -L https://x.example/latest/f", True),
    ("sh.curl.latest", "curl https://x.example/latest", False),
    ("sh.wget.latest", 'wget "https://x.example/latest"', True),
    ("sh.go.latest", "go install x.example/t@latest", True),
    ("sh.go.latest", "go install x.example/t@v1.2.3", False),
    ("ps.iwr.latest", "Invoke-WebRequest https://x.example/latest/f", True),
    ("sh.brew.head", "brew install --HEAD tool", True),
    ("sh.brew.head", "brew install tool", False),
    ("sh.curl.url", "curl 'https://x.example'", True),
    ("sh.wget.url", "wget ftp://x.example", False),
    ("sh.wget.url", "wget http://x.example/a", True),
    ("ps.iwr.url", "irm http://x.example/a", True),
    ("sh.gh.release", "gh release download --pattern x", True),
    ("sh.gh.release", "gh release download v1.2", False),
    ("sh.gh.release", "gh release download --tag v1", False),
    ("sh.git.clone", "git clone https://x.example/r", True),
    ("sh.git.clone", "git clone --branch v1.2.3 u", False),
    ("sh.git.clone", "git clone -b main u", True),
    ("sh.git.clone", "git clone -b v1.2 u --branch main u", True),
    ("sh.git.clone", "git clone --branch=v1.2 u", True),
    ("sh.pip", "pip install requests", True),
    ("sh.pip", "pip3 install requests==2.0", False),
    ("sh.pip", "pip install -r req.txt", False),
    ("sh.pip", "pip install -U requests", False),
    ("sh.npm", "npm install @a/b", True),
    ("sh.npm", "npm install a@1", False),
    ("sh.cargo", "cargo install tool", True),
    ("sh.cargo", "cargo install tool --version 1.0", False),
    ("sh.gem", "gem install tool", True),
    ("sh.gem", "gem install tool -v 1.0", False),
    ("sh.npx", "npx --yes @a/tool", True),
    ("sh.npx", "npx tool@1", False),
    ("ps.module", "Install-Module X", True),
    ("ps.module", "Install-Module X -RequiredVersion 1.0", False),
    ("sh.pip.git", "pip install git+https://x.example/r", True),
    ("sh.pip.git", "pip install git+https://x.example/r@main", False),
    ("js.fetch.latest", "fetch('https://x.example/latest')", True),
    ("js.axios.latest", "axios.get(`${u}/latest/f`)", True),
    ("js.got.latest", "got('https://x/latest/f')", True),
    ("js.http.latest", "https.get('https://x/latest/f')", True),
    ("js.exec.curl", "execSync('curl u')", True),
    ("js.exec.curl", "execSync('wget u')", False),
    ("js.child.curl", "child_process.spawn('curl')", True),
    ("js.fetch.url", "fetch(`https://x.example/a`)", True),
    ("js.axios.url", "axios.post( 'http://x')", True),
    ("py.urllib.latest", "urllib.request.urlopen('https://x/latest/f')", True),
    ("py.requests.latest", "requests.get(f'{u}/latest/')", True),
    ("py.subprocess.curl", "subprocess.run(['curl', u])", True),
    ("py.subprocess.wget", "subprocess.run(['wget', u])", True),
    ("py.urllib.url", 'urllib.request.urlopen("http://x")', True),
    ("py.requests.url", "requests.put('https://x')", False),
    ("py.requests.url", "requests.head( 'https://x')", True),
    ("docker.from.latest", "FROM a/b:latest", True),
    ("docker.from.untagged", "from scratch", True),
    ("docker.from.untagged", "FROM a:1", False),
    ("docker.run.curl", "RUN apt install curl", True),
    ("docker.run.wget", " RUN wget u", False),
    ("docker.run.wget", "run wget u", True),
    ("docker.add.url", "ADD https://x.example/f /f", True),
    ("docker.git.clone", "RUN git clone u", True),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(i, r, t) for i, (r, t, _) in enumerate(CASES)], "i int, rule string, text string")
    langs = sorted({r.lang for r in RULES})
    kinds = ("pipe", "plain", "url", "package")
    out = rows.select("i", F.concat(*[hits(lang, kinds, F.col("text")) for lang in langs]).alias("h")).collect()
    return {r["i"]: {RULES[k].rule_id for k in r["h"]} for r in out}


@pytest.mark.parametrize("i", range(len(CASES)), ids=lambda i: f"{CASES[i][0]}-{i}")
def test_rule(found, i):
    rule, _, expected = CASES[i]
    assert (rule in found[i]) is expected


def test_every_rule_has_a_match():
    assert len(RULES) == 41
    assert {r.rule_id for r in RULES} == {r for r, _, ok in CASES if ok}
