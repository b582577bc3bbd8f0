"""Owners of several keys against a sequential model, and keys that are found."""

import random

import pytest

from rowmill.operators import deduplicate
from rowmill.operators.deduplicate import Key, NoKey, chosen_key, discover_keys, owners_of_many


def model(rows):
    taken, owner = [set(), set()], [{}, {}]
    for n, *keys in rows:
        if not any(k in t for k, t in zip(keys, taken) if k is not None):
            for k, t, o in zip(keys, taken, owner):
                if k is not None:
                    t.add(k)
                    o[k] = n
    return owner


def owned(spark, rows):
    frames = owners_of_many(spark.createDataFrame(rows, "n long, a long, b long"), ["a", "b"], "n")
    return [{r[0]: r["owner"] for r in f.collect()} for f in frames]


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(deduplicate, "cut", lambda df, name, real=deduplicate.cut: (rounds.append(name), real(df, name))[1])
    # each row shares one key with the row before it, and the other with the one behind it
    rows = [(i, i, i + 1) if i % 2 == 0 else (i, i + 1, i) for i in range(10_000)]
    found = owned(spark, rows)
    assert found == model(rows) and len(found[0]) == 5000
    assert rounds.count("candidates") + rounds.count("chain") < 30


@pytest.mark.parametrize("seed", range(3))
def test_random_rows(spark, seed):
    r = random.Random(seed)
    wide = 5 if seed else 60
    rows = [(i, r.randrange(wide), r.randrange(wide)) for i in range(120)]
    assert owned(spark, rows) == model(rows)


def test_keys_are_found(spark):
    rows = [(i // 4, i % 4, i % 3, None if i == 5 else i, f"{i % 7}") for i in range(200)]
    df = spark.createDataFrame(rows, "`a.b` long, line long, other long, holes long, s string")
    assert [k.columns for k in discover_keys(df)] == [("a.b", "line"), ("a.b", "s")]
    assert discover_keys(df, 1) == [] and discover_keys(df.limit(0)) == []
    unique = spark.range(50).selectExpr("id AS k", "-id AS l", "id % 2 AS m")
    assert [k.columns for k in discover_keys(unique)] == [("k",), ("l",)]


def test_the_choice_of_keys():
    keys = [Key(("c",)), Key(("a", "b"), "unique", "u2"), Key(("b",), "unique", "u1"), Key(("z",), "primary", "p")]
    assert chosen_key(keys).name == "p" and chosen_key(keys[:3]).name == "u1" and chosen_key(keys[:1]).columns == ("c",)
    with pytest.raises(NoKey):
        chosen_key([])
