"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from shoal.llm import decontaminate, embedding_links, jaccard_join, line_templates, mixing, repeats, shuffle_shards, toxicity, url_filter, warc

QUERIES = {
    "op1_url_filter": url_filter.query,
    "op2_shuffle_shards": shuffle_shards.query,
    "op3_decontaminate": decontaminate.query,
    "op4_embedding_links": embedding_links.query,
    "op5_arc_to_warc": warc.query,
    "op6_pfair_mix": mixing.query,
    "op7_suffix_repeats": repeats.query,
    "op8_jaccard_join": jaccard_join.query,
    "op9_line_templates": line_templates.query,
    "op10_toxicity": toxicity.query,
}
SQL = {"op9_line_templates": line_templates.SQL, "op4_embedding_links": embedding_links.SQL, "op8_jaccard_join": jaccard_join.SQL, "op3_decontaminate": decontaminate.SQL, "op5_arc_to_warc": warc.SQL, "op7_suffix_repeats": repeats.SQL}
