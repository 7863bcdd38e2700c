"""Merkle manifest of a dataset (operator 13): a hash tree per group, one over the groups, and a proof for every row.

A row's leaf is the SHA-256 of its fields. Within a group the leaves stand by key; every ``fan`` consecutive nodes
become one node until one is left, the group's subroot; the subroots, by group, become the root alike. Places come from
range-partitioned running counts (``common.running``), so a group of any size is spread over many tasks, and
a node is one aggregation of at most ``fan`` rows.

Proofs are made by pointer jumping. Every node holds a pointer to an ancestor, its parent first, and the
segment of siblings on the way there. A self-join on the pointer doubles the distance and appends the
ancestor's segment, so after log2(height) rounds every node has reached the root. The leaves of one run share all that lies
above it: the run's node jumps for them, and each adds its own siblings in the run. A round that jumps ``d`` levels
has at most fan**d rows a key; where fewer than ``FEW`` ancestors are left to meet, they are broadcast.
"""

from __future__ import annotations

from mentionlake.llm.common import running, table
from mentionlake.session import materialize
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Ancestors broadcast at most; each holds a segment of at most height * (fan - 1) digests.
FEW = 2048
STEP = "array<struct<left:string,right:string>>"
#: The tree that stands over the groups' trees.
ABOVE = -1


def field(value: Column) -> Column:
    """A field as it is hashed: ``-`` for null, else its UTF-8 byte count, a colon and its text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _joined(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda c: c["hash"]), "")


def _node(members: Column, n: Column) -> Column:
    """The hash over a run; a tree's only node stands for itself."""
    return F.when(n > 1, F.sha2(_joined(members), 256)).otherwise(F.element_at(members, 1)["hash"])


def _step(members: Column, at: Column) -> Column:
    """The siblings before and after the member at place ``at`` (from 0)."""
    left, right = F.slice(members, F.lit(1), at), F.slice(members, at + 2, F.size(members))
    return F.struct(_joined(left).alias("left"), _joined(right).alias("right"))


def _runs(nodes: DataFrame, fan: int, label: str) -> DataFrame:
    """(tree, n, idx, members, hash) one level up. ``nodes``: tree, n (nodes of the tree on this level), idx, node (struct idx, hash, ...)."""
    runs = nodes.groupBy("tree", "n", F.expr(f"idx div {fan}").alias("run")).agg(F.array_sort(F.collect_list("node")).alias("members"))
    return materialize(runs.select("tree", F.col("n").alias("below"), F.expr(f"(n + {fan - 1}) div {fan}").alias("n"), F.col("run").alias("idx"), "members", _node(F.col("members"), F.col("n")).alias("hash")), label)


def _ident(tree, level: int, idx) -> Column:
    return F.struct(F.lit(tree).alias("tree") if isinstance(tree, int) else tree.alias("tree"), F.lit(level).alias("level"), idx.alias("idx"))


def _climb(nodes: DataFrame, level: int, most: int, fan: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Levels above ``nodes`` (tree, n, idx, hash): (pointers, tops). A pointer row is (id, up, steps); a top row (tree, level, hash) ends a tree."""
    pointers, tops = [], []
    while True:
        tops.append(nodes.filter("n = 1").select("tree", F.lit(level).alias("level"), "hash"))
        if most <= 1:
            return pointers, tops
        runs = _runs(nodes.filter("n > 1").select("tree", "n", "idx", F.struct("idx", "hash").alias("node")), fan, f"merkle-{level}")
        members = F.col("members")
        pointers.append(
            runs.select("tree", "idx", "members", F.posexplode("members").alias("at", "node")).select(
                _ident(F.col("tree"), level, F.col("node.idx")).alias("id"), _ident(F.col("tree"), level + 1, F.col("idx")).alias("up"), F.array(_step(members, F.col("at"))).alias("steps")
            )
        )
        nodes, level, most = runs.select("tree", "n", "idx", "hash"), level + 1, -(-most // fan)


def _jump(pointers: DataFrame, height: int) -> DataFrame:
    """(id, up, steps, subroot) with every pointer at the root (up is null)."""
    distance = 1
    while distance < height:
        ancestors = pointers.filter((F.col("id.level") > distance) | (F.col("id.tree") == ABOVE)).select(
            F.col("id").alias("up"), F.col("up").alias("further"), F.col("steps").alias("more"), F.col("subroot").alias("found")
        )
        if ancestors.limit(FEW + 1).count() <= FEW:
            ancestors = F.broadcast(ancestors)
        moved = pointers.filter("up is not null").join(ancestors, "up").select(
            "id", F.col("further").alias("up"), F.concat("steps", "more").alias("steps"), F.coalesce("subroot", "found").alias("subroot")
        )
        pointers = materialize(pointers.filter("up is null").unionByName(moved), f"merkle-jump-{distance}")
        distance *= 2
    return pointers


def prove(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "lang", carry: dict[str, Column] | None = None, fan: int = FAN) -> DataFrame:
    """One row per document: ``carry`` (the key unless given), leaf, subroot, root, steps.

    ``steps`` is the proof, one (left, right) pair of joined sibling digests per level from the leaf to the root; a level without
    siblings still hashes and has an empty pair. Groups stand null first and by UTF-8 bytes, leaves by key with
    null last, and by digest where keys repeat; rows alike in every field are leaves each. Null
    fields hash as ``-``. Other columns of ``docs`` take no part and cannot clash. An empty table has no rows and no root.
    """
    kept = carry or {key: docs[key]}
    rows = docs.select(docs[group].alias("grp"), docs[key].alias("ord"), leaf_of(*[docs[f] for f in fields]).alias("hash"), F.struct(*[c.alias(name) for name, c in kept.items()]).alias("kept"))
    rows = materialize(rows, "merkle-leaves")
    counts = materialize(rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).withColumn("named", F.col("grp").isNotNull()), "merkle-groups")
    facts = materialize(running(counts, "merkle-group-order", [], ["named", "grp"]).select("grp", "n", F.col("__index").alias("tree")), "merkle-trees")
    size = facts.agg(F.count(F.lit(1)).alias("trees"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()

    placed = running(rows, "merkle-order", ["grp"], ["ord", "hash"], facts=facts)
    member = F.struct(F.col("__index").alias("idx"), "hash", "kept")
    runs = _runs(placed.select("tree", "n", F.col("__index").alias("idx"), member.alias("node")), fan, "merkle-runs")
    within, tops = _climb(runs.select("tree", "n", "idx", "hash"), 1, -(-size.most // fan), fan)
    subroots = tops[0]
    for top in tops[1:]:
        subroots = subroots.unionByName(top)
    subroots = materialize(subroots, "merkle-subroots")

    pairs = subroots.select(F.lit(ABOVE).alias("tree"), F.lit(size.trees).alias("n"), F.col("tree").alias("idx"), "hash")
    above, ends = _climb(pairs, 0, size.trees, fan)
    root = ends[-1].select("hash").first()
    nothing = F.lit(None).cast("struct<tree:bigint,level:int,idx:bigint>")
    link = lambda df: df.select(
        F.struct(F.col("id.tree").cast("long").alias("tree"), "id.level", "id.idx").alias("id"),
        F.struct(F.col("up.tree").cast("long").alias("tree"), "up.level", "up.idx").alias("up"), "steps", F.lit(None).cast("string").alias("subroot"),
    )
    # A subroot is the top of its tree and the lowest node of the tree above: it points on from there.
    names = subroots.select("tree", _ident(F.col("tree"), 0, F.col("tree")).alias("low"), F.struct("tree", "level", F.lit(0).cast("long").alias("idx")).alias("id"), F.col("hash").alias("subroot"))
    if above:
        first = above[0].select(F.col("id.idx").alias("tree"), "up", "steps")
        bridge = names.join(first, "tree").select("id", F.struct(F.col("up.tree").cast("long").alias("tree"), "up.level", "up.idx").alias("up"), "steps", "subroot")
        peak = subroots.limit(1).select(F.struct(F.lit(ABOVE).cast("long").alias("tree"), F.lit(len(above)).alias("level"), F.lit(0).cast("long").alias("idx")).alias("id"), nothing.alias("up"), F.expr(f"cast(array() as {STEP})").alias("steps"), F.lit(None).cast("string").alias("subroot"))
    else:
        bridge = names.select("id", nothing.alias("up"), F.expr(f"cast(array() as {STEP})").alias("steps"), "subroot")
        peak = bridge.limit(0)
    pointers = bridge.unionByName(peak)
    for part in within + above[1:]:
        pointers = pointers.unionByName(link(part))
    reached = _jump(materialize(pointers, "merkle-pointers"), len(within) + len(above))

    lowest = reached.filter((F.col("id.level") == 1) & (F.col("id.tree") != ABOVE)).select(F.col("id.tree").alias("tree"), F.col("id.idx").alias("idx"), "steps", "subroot")
    leaves = runs.select("tree", "idx", "below", "members").join(lowest, ["tree", "idx"]).select("steps", "subroot", "below", "members", F.posexplode("members").alias("at", "node"))
    own = F.when(F.col("below") > 1, F.array(_step(F.col("members"), F.col("at")))).otherwise(F.expr(f"cast(array() as {STEP})"))
    return leaves.select("node.kept.*", F.col("node.hash").alias("leaf"), "subroot", F.lit(root[0] if root else None).alias("root"), F.concat(own, "steps").alias("steps"))


def proof_digest(steps: Column) -> Column:
    """SHA-256 of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def fold(leaf: Column, steps: Column) -> Column:
    """The root that follows from a leaf and its proof."""
    return F.aggregate(steps, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof, and whether it holds where a third of the texts was tampered with."""
    docs = table(spark, sf_dir, "documents")
    picked = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    changed = F.when(picked, leaf_of(*[lowered(F.col(f)) if f == "text" else F.col(f) for f in FIELDS]))
    proofs = prove(docs, carry={"doc_id": F.col("doc_id"), "changed": changed})
    return proofs.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), fold(F.coalesce("changed", "leaf"), F.col("steps")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root")
    )


def _sql_leaf(text: str) -> str:
    parts = [f"CAST({f} AS VARCHAR)" if f != "text" else text for f in FIELDS]
    return "sha256(" + " || ".join(f"coalesce(CAST(octet_length(encode({p})) AS VARCHAR) || ':' || {p}, '-')" for p in parts) + ")"


#: DuckDB has no CRC-32: bytes of the decimal text, eight shifts each.
_SQL_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, len(s) + 1), lambda i: CAST(ascii(substr(s, i, 1)) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""

OP13_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_sql_leaf("text")} AS leaf, {_sql_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS changed,
    coalesce({_SQL_CRC} % 3 = 0, false) AS picked, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, leaf) - 1 AS i
  FROM (SELECT *, CAST(doc_id AS VARCHAR) AS s FROM documents)
), within AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY i) AS nodes FROM d GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range(0, len(nodes), {FAN}), lambda k: sha256(array_to_string(nodes[k + 1:k + {FAN}], ''))) FROM within WHERE len(nodes) > 1
), subroots AS (
  SELECT lang, level AS height, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS t FROM within WHERE len(nodes) = 1
), above AS (
  SELECT 0 AS level, list(subroot ORDER BY t) AS nodes FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range(0, len(nodes), {FAN}), lambda k: sha256(array_to_string(nodes[k + 1:k + {FAN}], ''))) FROM above WHERE len(nodes) > 1
), levels AS (
  SELECT w.lang, w.level, w.nodes, 0 AS base, s.t, false AS upper FROM within w JOIN subroots s ON w.lang IS NOT DISTINCT FROM s.lang WHERE len(w.nodes) > 1
  UNION ALL
  SELECT s.lang, s.height + a.level, a.nodes, s.height, s.t, true FROM above a, subroots s WHERE len(a.nodes) > 1
), steps AS (
  SELECT d.doc_id, d.lang, d.i, l.level, l.nodes, CASE WHEN l.upper THEN l.t // CAST(power({FAN}, l.level - l.base) AS BIGINT) ELSE d.i // CAST(power({FAN}, l.level) AS BIGINT) END AS pos
  FROM d JOIN levels l ON d.lang IS NOT DISTINCT FROM l.lang
), sides AS (
  SELECT doc_id, lang, i, level, array_to_string(nodes[(pos // {FAN}) * {FAN} + 1:pos], '') AS lft, array_to_string(nodes[pos + 2:(pos // {FAN}) * {FAN} + {FAN}], '') AS rgt FROM steps
), proofs AS (
  SELECT lang, i, sha256(string_agg(lft || rgt, '' ORDER BY level)) AS proof FROM sides GROUP BY lang, i
), folds AS (
  SELECT lang, i, 0 AS level, CASE WHEN picked THEN changed ELSE leaf END AS node FROM d
  UNION ALL
  SELECT f.lang, f.i, f.level + 1, sha256(s.lft || f.node || s.rgt) FROM folds f JOIN sides s ON f.lang IS NOT DISTINCT FROM s.lang AND f.i = s.i AND f.level = s.level
), ends AS (
  SELECT lang, i, max_by(node, level) AS folded_root FROM folds GROUP BY lang, i
)
SELECT d.doc_id, d.leaf, s.subroot, (SELECT max_by(nodes[1], level) FROM above) AS root, coalesce(p.proof, sha256('')) AS proof_sha256, e.folded_root,
  e.folded_root = (SELECT max_by(nodes[1], level) FROM above) AS verified
FROM d JOIN subroots s ON d.lang IS NOT DISTINCT FROM s.lang JOIN ends e ON d.lang IS NOT DISTINCT FROM e.lang AND d.i = e.i
LEFT JOIN proofs p ON d.lang IS NOT DISTINCT FROM p.lang AND d.i = p.i
"""
