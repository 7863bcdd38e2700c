"""Operator 13 against a plain tree in Python, and against SQL."""

import random
from hashlib import sha256
from zlib import crc32

import pytest
from conftest import SMALL
from oracle_check import compare, duck
from pyspark.sql import functions as F

from mentionlake.llm import merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree long"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, change=False):
    values = [row.doc_id, row.source, row.lang, row.n_chars, row.text]
    if change and row.text is not None:
        values[-1] = "".join(c.lower() if "A" <= c <= "Z" else c for c in row.text)
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes, fan):
    """(top, the path of (left, right) of each node)"""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            low = i // fan * fan
            paths[k].append(("".join(nodes[low:i]), "".join(nodes[i + 1 : low + fan])))
            at[k] = i // fan
        nodes = [H(*nodes[i : i + fan]) for i in range(0, len(nodes), fan)]
    return nodes[0], paths


def brute(rows, fan):
    trees = {}
    for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, leaf(r))):
        trees.setdefault(r.lang, []).append(r)
    order = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    tops = {g: climb([leaf(r) for r in trees[g]], fan) for g in order}
    root, upper = climb([tops[g][0] for g in order], fan)
    for g, over in zip(order, upper):
        for r, path in zip(trees[g], tops[g][1]):
            steps = path + over
            node = leaf(r, r.doc_id is not None and crc32(str(r.doc_id).encode()) % 3 == 0)
            for left, right in steps:
                node = H(left, node, right)
            yield (r.doc_id, leaf(r), tops[g][0], root, H(*[x for s in steps for x in s]), node, node == root)


def query(docs, fan):
    picked = F.coalesce(F.crc32(docs.doc_id.cast("string")) % 3 == 0, F.lit(False))
    changed = F.when(picked, M.leaf_of(*[M.lowered(docs[f]) if f == "text" else docs[f] for f in M.FIELDS]))
    p = M.prove(docs, carry={"doc_id": docs.doc_id, "changed": changed}, fan=fan)
    folded = M.fold(F.coalesce("changed", "leaf"), F.col("steps"))
    return p.select("doc_id", "leaf", "subroot", "root", M.proof_digest(F.col("steps")), folded, folded == F.col("root"))


def made(langs, sizes):
    r = random.Random(8)
    rows = []
    for g, n in zip(langs, sizes):
        for _ in range(n):
            i = len(rows) * 3 % 1009
            rows.append((i if i % 50 else None, r.choice(["s", None, "é"]), g, r.choice([None, 5]), r.choice([None, "", "Some Text É", "lower", "X" * 300]), "x", 1))
    return rows + rows[:5] * 3


CASES = {
    "several": (2, ["en", "de", None, "", "é", "zz"], [37, 1, 9, 2, 16, 5]),
    "one group": (3, ["en"], [28]),
    "many groups": (2, [f"g{i}" for i in range(11)], [1, 2, 3] * 3 + [70, 4]),
    "eight": (8, ["a", None], [130, 8]),
}


@pytest.mark.parametrize("case", list(CASES))
@pytest.mark.parametrize("few", [0, 2048])
def test_proofs(spark, case, few, monkeypatch):
    monkeypatch.setattr(M, "FEW", few)
    fan, langs, sizes = CASES[case]
    docs = spark.createDataFrame(made(langs, sizes), SCHEMA)
    want = sorted(brute(docs.collect(), fan), key=repr)
    assert sorted((tuple(r) for r in query(docs, fan).collect()), key=repr) == want
    assert any(not w[-1] for w in want)


def test_lone_and_empty(spark):
    docs = spark.createDataFrame([(3, None, None, None, None, "x", 1)], SCHEMA)
    (row,) = M.prove(docs).collect()
    assert row.leaf == row.subroot == row.root == H("1:3----") and row.steps == []
    assert M.prove(docs.limit(0)).collect() == []


def test_sql(spark):
    assert compare(spark, duck(SMALL), M.op13_merkle, M.OP13_SQL, SMALL)[0] == "ok"
