from __future__ import annotations

import random

from ledgerlens.operators import trigrams


def test_lookups_equal_a_scan(spark, tmp_path):
    rng = random.Random(5)
    names = ["".join(rng.choices("abAB é-", k=rng.randrange(0, 12))) for _ in range(400)] + [None, "", "ab", "aaaa", "aaaa", "İstanbul"]
    rows = [(i if i < 403 else 403, n, "Org") for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "entity_id long, text string, type string").repartition(3)
    trigrams.store_names(df, str(tmp_path))
    total = spark.read.parquet(f"{tmp_path}/grams").count()
    for asked in ["aba", "ABAB", "é-a", "aaa", "aaaa", "a", "", "ab", "zzz", "b a b"]:
        got = sorted((r.entity_id, r.text) for r in trigrams.names_with(spark, str(tmp_path), asked).collect())
        assert got == sorted((i, n) for i, n, _ in rows if n is not None and asked.lower() in n.lower()), asked
        assert trigrams.candidates(spark, str(tmp_path), asked) < total
    assert trigrams.names_with(spark, str(tmp_path), "zzz").columns == df.columns


def test_empty(spark, tmp_path):
    trigrams.store_names(spark.createDataFrame([], "entity_id long, text string"), str(tmp_path))
    assert trigrams.names_with(spark, str(tmp_path), "abc").count() == 0 == trigrams.names_with(spark, str(tmp_path), "a").count()
