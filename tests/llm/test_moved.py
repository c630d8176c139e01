"""What the pipeline's stages move and leave on disk: texts that meet no other, or hold nothing to hide by terms, are not shuffled."""

import os
import random
import time

import pytest

import corpus_pipeline
from siftloom.llm.common import parted
from siftloom.shared import settled, shared_dir, write_shared

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def large_joins(spark):
    """Joins as on large tables: none is broadcast unless asked for."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def shuffled(spark):
    """Bytes that shuffles have written so far."""
    time.sleep(1)
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def tables(spark):
    return set(os.listdir(shared_dir(spark).removeprefix("file:")))


def random_text(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=20)) for _ in range(n))


def test_near_duplicates_move_no_lone_text(spark, tmp_path, large_joins):
    rows = [(i, random_text(i, 3000), "en", "s", 1) for i in range(60)]
    rows += [(100, rows[3][1], "en", "s", 1), (101, rows[4][1] + " end", "en", "s", 1)]
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(str(tmp_path / "d"))
    docs, before, there = spark.read.parquet(str(tmp_path / "d")), shuffled(spark), tables(spark)
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == list(range(60))
    # Copies and their originals, their sets, and what is known of every text; not the texts.
    assert shuffled(spark) - before < 0.4 * sum(len(r[1]) for r in rows)
    assert not [n for n in tables(spark) - there if n.startswith(("sketches-", "shingle-sets-", "bucket-members-"))]


def test_masking_moves_no_text_without_hits(spark, tmp_path, large_joins):
    """A term that tells of addresses occurs alone in one text: that text is joined with its hits, the others stay."""
    pairs = [f"quokkaline ask u{i}@x{i}.example.org now {' '.join(random.Random(i).sample(WORDS, 12))}" for i in range(40)]
    texts = [*pairs, "here the quokkaline stands alone", *(random_text(1000 + i, 3000) for i in range(60)), None, ""]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(str(tmp_path / "d"))
    docs, before = spark.read.parquet(str(tmp_path / "d")), shuffled(spark)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.personal_data(spark, docs, "").collect()}
    assert len(got) == len(texts) and "quokkaline" not in got[40]
    assert all(got[i] == t for i, t in enumerate(texts) if i > 40)
    assert shuffled(spark) - before < 0.4 * sum(len(t or "") for t in texts)


WORDS = [a + b + c for a in ("bram", "cold", "fern", "gris", "hulm", "jast") for b in ("ami", "eko", "ilu", "ona", "upe") for c in ("ble", "dor", "fin", "gal", "hest", "lom")]


def test_parted_loses_no_row(spark):
    rows = spark.range(2000).selectExpr("xxhash64(id) as key", "id").unionAll(spark.sql("SELECT -1L, -1L UNION ALL SELECT 63L, -2L UNION ALL SELECT 0L, -3L"))
    keys = rows.where("id % 7 = 0 or id < 0").select("key")
    among, rest = (sorted(r["id"] for r in d.collect()) for d in parted(rows, keys))
    assert sorted(among + rest) == [*range(-3, 0), *range(2000)]
    assert {i for i in range(-3, 2000) if i < 0 or i % 7 == 0} <= set(among) and len(among) < 400
    among, rest = (d.count() for d in parted(rows, keys.limit(0)))
    assert (among, rest) == (0, 2003)


def test_settled_keeps_its_result_only(spark):
    outer = write_shared(spark.range(3), "outer")
    got = settled(spark, "kept", lambda: write_shared(outer.selectExpr("id + 1 as id"), "between").where("id > 1"))
    assert sorted(r["id"] for r in got.collect()) == [2, 3] and outer.count() == 3
    assert not [n for n in tables(spark) if n.startswith("between-")]
