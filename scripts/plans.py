"""Write the physical plans of the headline operators to PLANS.md.

usage: python scripts/plans.py [sf_dir]
"""

from __future__ import annotations

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql import functions as F  # noqa: E402

from trendloom.operators import detect, graph, status as st, terms, track  # noqa: E402
from trendloom.operators.target import target_partition  # noqa: E402
from trendloom.plans import q_graph, q_status, q_terms  # noqa: E402
from trendloom.session import local_session  # noqa: E402
from trendloom.sources import derived  # noqa: E402
from trendloom.sources.tables import table  # noqa: E402


def plan(df) -> str:
    text = df._jdf.queryExecution().executedPlan().toString()
    return "\n".join(line[:230] for line in text.splitlines())


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(8, 8)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    conf = derived.confidences(spark, sf)
    part = target_partition(docs, conf, "purchase", 0.5)
    s = derived.nested_statuses(spark, sf)
    items = [
        ("Flagship, stage 1: target partition -> tokens -> term counts (checkpointed)",
         "Semi join on the filtered detection rows, one regex projection, explode, stop words "
         "as InSet, partial + final hash aggregate on the term.",
         terms.term_counts(part)),
        ("Flagship, stage 2: tf, baseline join, top 400",
         "Reads the checkpointed counts; total as a scalar subquery over them; join with the "
         "baseline by AQE's choice; TakeOrderedAndProject.",
         q_terms.q_trending_terms(spark, sf)),
        ("IDF over 1-3-grams",
         "Tokens projected once, grams built with zip_with, array_distinct per document, "
         "partial + final count per gram.",
         terms.idf_grams(docs)),
        ("Collected table (F2 -> J5 -> P1..P7)",
         "Retweet filter, anti joins against the asset listing, one projection to 32 columns.",
         st.collect_rows(s, derived.assets(spark, sf))),
        ("Tracked phrases, inverted index",
         "Tokens through the evaluate-once generator, distinct tokens exploded, size-checked "
         "broadcast of (term, phrase), count per (status, phrase).",
         track.match_phrases(q_status._flat_text(spark, sf), q_status._phrases(spark))),
        ("Neighbour cap (W1)",
         "row_number() <= 2 per source: partial WindowGroupLimit before the shuffle.",
         graph.cap_neighbours(derived.edges(spark, sf), 2, q_graph.spread_order())),
        ("Per-user photo cap (W2/A10)",
         "Partial WindowGroupLimit per user before the shuffle, then distinct.",
         st.distinct_media(s, 3)),
        ("Greedy suppression (W5)",
         "Candidates per image sorted, then an aggregate() fold; no Python.",
         detect.suppress_overlaps(derived.detections(spark, sf), 0.3, 0.3)),
    ]
    out = ["# Physical plans (generated by scripts/plans.py, sf0.1, local[8])", ""]
    for title, note, df in items:
        out += [f"## {title}", "", note, "", "```", plan(df), "```", ""]
    with open(os.path.join(ROOT, "PLANS.md"), "w") as f:
        f.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
