"""Stages keep the caller's columns whatever their names, and tell rows apart where hashes collide."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfscope.llm import exact_dedup, mixing, quality_rules, simhash

STAGES = {"quality_rules": quality_rules.accepted, "exact_dedup": exact_dedup.deduplicated, "simhash": simhash.representatives,
          "mixing": mixing.mixed}
NAMES = ["_s", "_id", "_sha", "_row", "_lang", "_source", "_key", "_pass", "_passes", "row", "id", "sha", "kept_id", "kept_sha", "l",
         "s", "k", "one", "passes", "copies", "fp", "root", "unit", "size", "taken", "key", "h", "norm", "slot", "bucket", "kept",
         "node", "more", "target", "w", "_n", "a`b", "c.d"]


@pytest.mark.parametrize("stage", STAGES)
def test_columns_of_any_name_come_through(docs, odd, stage):
    plain_columns = ["doc_id", "text", "lang", "source"]
    for table in (docs.select(*plain_columns), odd.select(*plain_columns)):
        plain = Counter(map(tuple, STAGES[stage](table).collect()))
        own = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("source", F.lit("-")))
        more = table.select("*", *[F.concat(F.lit(f"{n}="), own).alias(n) for n in NAMES])
        out = STAGES[stage](more)
        assert out.columns == more.columns
        rows = out.collect()
        assert Counter(tuple(r[:4]) for r in rows) == plain
        for r in rows:
            want = f"{'null' if r[0] is None else r[0]}/{'-' if r[3] is None else r[3]}"
            assert [r[4 + i] for i in range(len(NAMES))] == [f"{n}={want}" for n in NAMES]


@pytest.mark.parametrize("stage", ["quality_rules", "simhash", "mixing"])
def test_rows_whose_hashes_collide_are_told_apart(docs, stage, monkeypatch):
    module = {"quality_rules": quality_rules, "simhash": simhash, "mixing": mixing}[stage]
    if stage == "mixing":      # the draw depends on the hash, so only the totals are compared
        before = module.mix(docs).agg(F.count(F.lit(1)), F.sum("size")).first()
    else:
        before = Counter(r["doc_id"] for r in STAGES[stage](docs).collect())
    monkeypatch.setattr(module, "row_key", lambda *a: F.lit(7).cast("long"))
    if stage == "mixing":
        assert module.mix(docs).agg(F.count(F.lit(1)), F.sum("size")).first() == before
        taken = {r["doc_id"]: r["taken"] // max(1, r["size"]) for r in module.mix(docs).collect()}
        assert Counter(r["doc_id"] for r in module.mixed(docs).collect()) == Counter({i: n for i, n in taken.items() if n})
    else:
        assert Counter(r["doc_id"] for r in STAGES[stage](docs).collect()) == before


def test_of_rows_that_share_id_and_text_the_first_language_and_source_stays(spark):
    schema = "doc_id long, text string, lang string, source string"
    rows = [(1, "one text of some words", "en", "b"), (1, "one text of some words", "en", "a"), (1, "one text of some words", "de", "z"),
            (2, "another text that is alone", None, None)]
    docs = spark.createDataFrame(rows, schema).repartition(4)
    for stage in ("exact_dedup", "simhash"):
        assert sorted(map(tuple, STAGES[stage](docs).collect())) == [rows[2], rows[3]]
    docs = docs.unionByName(spark.createDataFrame([(1, "one text of some words", None, "z")], schema))
    for stage in ("exact_dedup", "simhash"):
        assert [r["lang"] for r in STAGES[stage](docs).collect() if r["doc_id"] == 1] == [None]
