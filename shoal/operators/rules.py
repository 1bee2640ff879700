"""The 41 detection rules.

Rules are rows: language, kind, severity, category, a pattern that must match a line and a guard that
must not. They become one projection of literal predicates, so the patterns are compiled once.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a fetch, an interpreter, a floating version, a package name.
FETCH = "(?:curl|wget)"
WEB_VERBS = "Invoke-WebRequest|iwr|Invoke-RestMethod|irm"
WEB_REQUEST = f"(?:{WEB_VERBS})"
INTERPRETER = "(?:bash|sh|zsh|dash|ash|ksh|fish|python3?)"
LATEST = r"""[/=]latest[/\s"]"""
LATEST_QUOTED = r"""[/=]latest[/\s"']"""
URL = r"""https?://[^\s"']+"""
NAME = "[a-zA-Z][a-zA-Z0-9_-]*"
SCOPED = f"(?:@{NAME}/)?{NAME}"
QUOTE = "[\"'`]"
CHECKSUM = r"(?i)(?:sha256sum|sha512sum|shasum|openssl\s+dgst|gpg\s+--verify|Get-FileHash)"
SHA_CHECKOUT = r"git\s+checkout\s+[0-9a-f]{40}\b"
DIGEST_FROM = r"(?i)^FROM\s+\S+@sha256:"
CLONE_PINNED = r"git\s+clone\s+.*(?:--branch|-b)\s+(?=\S*[0-9]+(?:\.[0-9]+)+)\S+(?!.*(?:--branch|-b)\s+\S)"


class Rule(NamedTuple):
    rule_id: str
    lang: str  # shell, javascript, python, dockerfile
    kind: str  # pipe, plain, url, package
    severity: str
    category: str
    pattern: str
    description: str
    guard: str | None = None


def _shell(rule_id: str, kind: str, severity: str, pattern: str, description: str, guard: str | None = None) -> Rule:
    return Rule(rule_id, "shell", kind, severity, "shell_fetch", pattern, description, guard)


# Which lines a rule matches and which of them its guard lets go, with kind and severity.
RULES: tuple[Rule, ...] = (
    _shell("sh.pipe", "pipe", "high", rf"(?i)\b{FETCH}\b[^|]*\|\s*(?:sudo\s+)?{INTERPRETER}\b", "download piped into an interpreter"),
    _shell("sh.procsub", "pipe", "high", rf"(?i)\b{INTERPRETER}\s+<\(\s*{FETCH}\b", "interpreter reads a download by process substitution"),
    _shell("sh.cmdsub", "pipe", "high", rf"""(?i)\b(?:bash|sh|zsh|eval)\b[^"']*["']?\$\(\s*{FETCH}\b""", "interpreter runs a download by command substitution"),
    _shell("ps.iex", "pipe", "high", rf"(?i)\b(?:iex|Invoke-Expression)\b.*\b(?:{WEB_VERBS}|DownloadString)\b", "PowerShell evaluates a download"),
    _shell("sh.curl.latest", "plain", "high", rf"curl\b.*{LATEST}", "curl fetches a latest release"),
    _shell("sh.wget.latest", "plain", "high", rf"wget\b.*{LATEST}", "wget fetches a latest release"),
    _shell("sh.go.latest", "plain", "medium", r"go\s+install\s+\S+@latest", "go install of a latest version"),
    _shell("ps.iwr.latest", "plain", "high", rf"(?i){WEB_REQUEST}\b.*{LATEST}", "PowerShell request fetches a latest release"),
    _shell("sh.brew.head", "plain", "medium", r"(?i)\bbrew\s+install\b.*--head\b", "brew install from the development head"),
    _shell("sh.curl.url", "url", "medium", rf"curl\b.*{URL}", "curl fetches a URL without a version"),
    _shell("sh.wget.url", "url", "medium", rf"wget\b.*{URL}", "wget fetches a URL without a version"),
    _shell("ps.iwr.url", "url", "medium", rf"(?i){WEB_REQUEST}\b.*{URL}", "PowerShell request fetches a URL without a version"),
    _shell("sh.gh.release", "package", "medium", r"gh\s+release\s+download\s", "gh release download without a version", r"gh\s+release\s+download\s+(?:v?[0-9]|--tag\s+v?[0-9])"),
    _shell("sh.git.clone", "package", "medium", r"git\s+clone\s", "git clone without a pinned ref", CLONE_PINNED),
    _shell("sh.pip", "package", "low", rf"pip3?\s+install\s+{NAME}(?:\s|$)", "pip install without a version", r"pip3?\s+install\s+\S*[=>~]=|pip3?\s+install\s+-r\s"),
    _shell("sh.npm", "package", "low", rf"npm\s+install\s+{SCOPED}(?:\s|$)", "npm install without a version", r"npm\s+install\s+\S+@[0-9]"),
    _shell("sh.cargo", "package", "low", rf"cargo\s+install\s+{NAME}(?:\s|$)", "cargo install without a version", r"cargo\s+install\s+(?:\S+@[0-9]|.*--version\s)"),
    _shell("sh.gem", "package", "low", rf"gem\s+install\s+{NAME}(?:\s|$)", "gem install without a version", r"gem\s+install\s+.*(?:-v\s+[0-9]|--version\s)"),
    _shell("sh.npx", "package", "medium", rf"\bnpx\s+(?:-\S+\s+)*{SCOPED}", "npx runs a package without a version", r"\bnpx\s+.*\S+@[0-9]"),
    _shell("ps.module", "package", "medium", r"(?i)\bInstall-(?:Module|Script)\b", "PowerShell module without a required version", r"(?i)-RequiredVersion\s+\S+"),
    _shell("sh.pip.git", "package", "medium", r"pip3?\s+install\b[^#]*\bgit\+https?://\S+", "pip install from a git URL without a ref", r"\bgit\+https?://\S+@\S+"),
    *(
        Rule(rule_id, "javascript", kind, severity, "javascript_fetch", pattern, description)
        for rule_id, kind, severity, pattern, description in (
            ("js.fetch.latest", "plain", "high", rf"fetch\s*\(.*{LATEST_QUOTED}", "fetch() of a latest release"),
            ("js.axios.latest", "plain", "high", rf"axios\.\w+\s*\(.*{LATEST_QUOTED}", "axios request of a latest release"),
            ("js.got.latest", "plain", "high", rf"got\s*\(.*{LATEST_QUOTED}", "got() of a latest release"),
            ("js.http.latest", "plain", "high", rf"https?\.get\s*\(.*{LATEST_QUOTED}", "http get of a latest release"),
            ("js.exec.curl", "plain", "high", r"exec\w*\s*\(.*\bcurl\b", "exec of curl"),
            ("js.child.curl", "plain", "high", r"child_process.*\bcurl\b", "child process runs curl"),
            ("js.fetch.url", "url", "medium", rf"fetch\s*\(\s*{QUOTE}https?://", "fetch() of a URL without a version"),
            ("js.axios.url", "url", "medium", rf"axios\.\w+\s*\(\s*{QUOTE}https?://", "axios request of a URL without a version"),
        )
    ),
    *(
        Rule(rule_id, "python", kind, severity, "python_fetch", pattern, description)
        for rule_id, kind, severity, pattern, description in (
            ("py.urllib.latest", "plain", "high", rf"urllib\.request\.urlopen\s*\(.*{LATEST_QUOTED}", "urlopen of a latest release"),
            ("py.requests.latest", "plain", "high", rf"requests\.(?:get|post|head)\s*\(.*{LATEST_QUOTED}", "requests call for a latest release"),
            ("py.subprocess.curl", "plain", "high", r"subprocess\b.*\bcurl\b", "subprocess runs curl"),
            ("py.subprocess.wget", "plain", "high", r"subprocess\b.*\bwget\b", "subprocess runs wget"),
            ("py.urllib.url", "url", "medium", r"""urllib\.request\.urlopen\s*\(\s*["']https?://""", "urlopen of a URL without a version"),
            ("py.requests.url", "url", "medium", r"""requests\.(?:get|post|head)\s*\(\s*["']https?://""", "requests call for a URL without a version"),
        )
    ),
    *(
        Rule(rule_id, "dockerfile", kind, severity, "docker_unpinned", pattern, description, guard)
        for rule_id, kind, severity, pattern, description, guard in (
            ("docker.from.latest", "plain", "high", r"(?i)^FROM\s+\S+:latest\b", "base image with the latest tag", None),
            ("docker.from.untagged", "plain", "high", r"(?i)^FROM\s+[a-z][a-z0-9._/-]*(?:\s|$)", "base image without a tag", None),
            ("docker.run.curl", "plain", "medium", r"(?i)^RUN\b.*\bcurl\b", "RUN step uses curl", None),
            ("docker.run.wget", "plain", "medium", r"(?i)^RUN\b.*\bwget\b", "RUN step uses wget", None),
            ("docker.add.url", "url", "medium", r"(?i)^ADD\b[^#]*\bhttps?://\S+", "ADD of a URL without a version", None),
            ("docker.git.clone", "package", "medium", r"git\s+clone\s", "git clone in a Dockerfile without a pinned ref", CLONE_PINNED),
        )
    ),
)
BY_ID = {r.rule_id: r for r in RULES}
#: Any rule's pattern needs one of these; a line without them is not looked at any further.
PREFILTER = r"(?i)curl|wget|iwr|irm|invoke-|iex|install|npx|git\s+clone|gh\s+release|fetch|axios|got|https?\.get|exec|child_process|urlopen|requests|subprocess|from|run|add"


def java(pattern: str) -> str:
    """Unicode classes, and line feeds as the only line ends, as the patterns are meant."""
    return "(?Ud)" + pattern


def matches(rule: Rule, line: Column) -> Column:
    hit = line.rlike(java(rule.pattern))
    return hit & ~line.rlike(java(rule.guard)) if rule.guard else hit


def hits(lang: str, kinds: tuple[str, ...], line: Column) -> Column:
    """Array of the positions in RULES of the language's rules that match."""
    own = [(i, r) for i, r in enumerate(RULES) if r.lang == lang and r.kind in kinds]
    return F.filter(F.array(*[F.when(matches(r, line), F.lit(i)) for i, r in own]), lambda x: x.isNotNull())
