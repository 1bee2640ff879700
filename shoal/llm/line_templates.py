"""Line dedup by a log-template tree; DataFrame functions only.

A line's tokens that hold a digit are variable from the start. The tree has a fixed depth: the number
of tokens, then the LEAD leading tokens. In a leaf, a token that stands at its place in fewer than
`min_docs` documents is a variable field too; a line of which at least SIMILAR of the tokens stay
fixed takes that generalised template, any other keeps its own. Lines whose template is found in
`min_docs` documents or more are dropped, wherever they stand.

Lines end at line feeds; blank lines are kept and have no template. Rows equal in id and text are one
document. Null texts have no lines and stay null; empty texts stay empty. Ties can't occur: templates
are counted, not ranked. Only narrow rows of hashes are shuffled, besides the texts that lose lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.llm.shared import staged

MIN_DOCS, LEAD, SIMILAR = 10, 3, 0.6
#: Leaves that may be sent to all tasks (8 bytes each).
MOST_LEAVES = 500_000


def masked(text: Column) -> Column:
    """The text's lines with single spaces, none outside, and tokens with digits as <*>.

    One pass over the array for each step, so that no step is worked out twice.
    """
    lines = F.transform(F.split(text, "\n"), lambda x: F.btrim(F.translate(x, "\t\x0b\f\r", "    "), F.lit(" ")))
    lines = F.transform(lines, lambda x: F.when(x.contains("  "), F.regexp_replace(x, " +", " ")).otherwise(x))
    return F.transform(lines, lambda x: F.when(x.rlike("[0-9]"), F.regexp_replace(x, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", "<*>")).otherwise(x))


def tree(docs: DataFrame) -> DataFrame:
    """(key, no, line, leaf, tpl) of every line: the masked line, the hash of its leaf and that of its own
    template; blank lines have neither hash."""
    lines = docs.select("key", F.posexplode(masked(F.col("text"))).alias("no", "line"))
    n = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    full = F.col("line") != ""
    return lines.select("key", "no", "line", F.when(full, F.xxhash64(n, F.substring_index("line", " ", LEAD))).alias("leaf"), F.when(full, F.xxhash64("line")).alias("tpl"))


def drop_templates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per row of docs: id, n_lines (not blank), n_dropped, kept_text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("key", F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("id").isNull(), "text"))
    found = staged(tree(rows).select("key", "no", "leaf", "tpl"), "lines")
    full = found.where("tpl is not null")
    per_doc = full.select("key", "leaf", "tpl").distinct()
    tpl_docs = per_doc.groupBy("leaf", "tpl").agg(F.count("*").alias("docs"))
    leaves = staged(tpl_docs.groupBy("leaf").agg(F.count("*").alias("kinds"), F.sum("docs").alias("docs")).where(f"kinds > 1 and docs >= {min_docs}").select("leaf"), "leaves")
    small = leaves.count() <= MOST_LEAVES
    # Token counts in leaves that several templates share; each template is looked at once.
    inside = tree(rows).join(F.broadcast(leaves) if small else leaves, "leaf", "left_semi")
    kinds = inside.groupBy("leaf", "tpl").agg(F.first("line").alias("line")).join(tpl_docs, ["leaf", "tpl"])
    kinds = staged(kinds, "templates")
    places = kinds.select("leaf", "tpl", "docs", F.posexplode(F.split("line", " ")).alias("at", "token"))
    often = places.groupBy("leaf", "at", "token").agg(F.sum("docs").alias("n")).where(f"n >= {min_docs}").select("leaf", "at", "token", F.lit(True).alias("fixed"))
    general = places.join(often, ["leaf", "at", "token"], "left").withColumn("token", F.when(F.col("fixed"), F.col("token")).otherwise("<*>"))
    general = general.groupBy("leaf", "tpl").agg(F.count_if(F.col("fixed") & (F.col("token") != "<*>")).alias("n_fixed"), F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]), " ").alias("text"))
    general = staged(general.where(f"n_fixed >= {SIMILAR} * n").select("tpl", F.xxhash64("text").alias("gen")), "general")
    gen = per_doc.select("key", "tpl").join(general, "tpl", "left").select("key", "tpl", F.coalesce("gen", "tpl").alias("gen"))
    recurring = gen.select("key", "gen").distinct().groupBy("gen").agg(F.count("*").alias("docs")).where(f"docs >= {min_docs}").select("gen")
    gone = general.join(recurring, "gen", "left_semi").select("tpl").unionByName(
        tpl_docs.select("tpl").join(general, "tpl", "left_anti").join(recurring.withColumnRenamed("gen", "tpl"), "tpl", "left_semi")
    ).distinct().withColumn("gone", F.lit(True))
    # Blank lines have no template to be joined by.
    marks = full.join(gone, "tpl", "left").select("key", "no", F.coalesce("gone", F.lit(False)).alias("gone"), F.lit(True).alias("full"))
    marks = marks.unionByName(found.where("tpl is null").select("key", "no", F.lit(False).alias("gone"), F.lit(False).alias("full"))).distinct()
    per_key = marks.groupBy("key").agg(F.count_if("full").alias("n_lines"), F.count_if("gone").alias("n_dropped"), F.collect_list(F.struct("no", "gone")).alias("marks"))
    marked = per_key.select("key", "n_lines", "n_dropped", F.when(F.col("n_dropped") > 0, F.transform(F.array_sort("marks"), lambda m: m["gone"])).alias("mask"))
    out = rows.join(marked, "key", "left")
    left = F.filter(F.zip_with(F.split("text", "\n"), "mask", lambda line, gone: F.when(~gone, line)), lambda line: line.isNotNull())
    kept = F.when(F.col("mask").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), kept.alias("kept_text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: all documents; templates of ten documents or more are dropped."""
    out = drop_templates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
with l as (select doc_id, unnest(range(0, len(s))) as no, unnest(s) as raw from (select doc_id, string_split(text, chr(10)) as s from documents)),
m as (select doc_id, no, raw, regexp_replace(regexp_replace(raw, '^[ \t\x0B\f\r]+|[ \t\x0B\f\r]+$', '', 'g'), '[^ \t\x0B\f\r]*[0-9][^ \t\x0B\f\r]*', '<*>', 'g') as line from l),
t as (select *, case when line <> '' then string_split_regex(line, '[ \t\x0B\f\r]+') end as tokens from m),
f as (select *, array_to_string(tokens, ' ') as tpl, concat(len(tokens), '|', array_to_string(tokens[1:3], ' ')) as leaf from t where tokens is not null),
k as (select leaf, tpl, any_value(tokens) as tokens, count(distinct doc_id) as docs from f group by leaf, tpl),
s as (select leaf from k group by leaf having count(*) > 1 and sum(docs) >= 10),
p as (select leaf, tpl, docs, unnest(range(0, len(tokens))) as place, unnest(tokens) as token from k where leaf in (select leaf from s)),
o as (select leaf, place, token from p group by leaf, place, token having sum(docs) >= 10),
g as (select p.leaf, p.tpl, count(*) filter (where o.token is not null and p.token <> '<*>') as n_fixed, count(*) as n, string_agg(coalesce(o.token, '<*>'), ' ' order by p.place) as gen
      from p left join o on p.leaf = o.leaf and p.place = o.place and p.token = o.token group by p.leaf, p.tpl),
a as (select f.doc_id, f.no, case when g.n_fixed >= 0.6 * g.n then g.gen else f.tpl end as gen from f left join g on f.leaf = g.leaf and f.tpl = g.tpl),
r as (select gen from a group by gen having count(distinct doc_id) >= 10),
d as (select doc_id, no from a where gen in (select gen from r)),
kept as (select l.doc_id, string_agg(l.raw, chr(10) order by l.no) as kept from l left join d on l.doc_id = d.doc_id and l.no = d.no where d.no is null group by l.doc_id)
select x.doc_id, cast((select count(*) from f where f.doc_id = x.doc_id) as bigint) as n_lines, cast((select count(*) from d where d.doc_id = x.doc_id) as bigint) as n_dropped, sha256(coalesce(kept.kept, '')) as kept_sha256
from documents x left join kept on x.doc_id = kept.doc_id
"""
