"""Merkle manifest: a digest tree over the rows of each group, and one over the groups' roots, with a proof a row.

Rows of a group ascend by their order column; every ``FANOUT`` consecutive nodes
become the digest of their digests until one node is left, the group's subroot, and
the subroots, ordered by group, likewise give the root. A level is one pass of lag
and lead columns of fixed offsets over the nodes, masked by a node's slot in its run
and by the run's length: they are the siblings, and the rows of first children hash
the parents.

Positions come from ranges of (group, order) and the counts of earlier ranges, and
a window holds one run, so a group that has a third of all rows is dealt over all
tasks. Proofs go down from the root: a node's are its own siblings and its parent's,
met by one join on (group, run), the key its window was dealt by. Rows are shuffled
as digests, never with their texts. The number of jobs grows with the logarithm of the
largest group.

A null group is a group of its own and comes first; null order values come first, and
ties are ordered by digest, so equal rows take neighbouring places. Null
fields count as ``-``, empty texts as ``0:``; a very long text is digested in one
go. A table of one row has an empty proof and its leaf as root. An empty table gives
an empty result. Columns of the data called like an output or like
something used inside stay out of the way: only what is named is read, and what is carried is sealed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkprep.llm import common as c

FANOUT = 16


def field_digest(*fields: Column) -> Column:
    """Hexadecimal SHA-256 of the fields: each its UTF-8 byte count, a colon and its value, or ``-`` if null."""

    def told(field: Column) -> Column:
        value = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[told(f) for f in fields]), 256)


def _positioned(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with ``_pos`` (from 0) and ``_n``, the number of rows, in their group: ranges of the order, and the group's rows in earlier ranges."""
    by = [F.col(x).asc_nulls_first() for x in (group, *order)]
    dealt = c.durable(rows.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy("_range", F.col(group).alias("_of")).agg(F.count("*").alias("_here"))  # a range's inner groups are in no other range
    of = Window.partitionBy("_of")
    counts = counts.withColumn("_before", F.sum("_here").over(of.orderBy("_range")) - F.col("_here")).withColumn("_n", F.sum("_here").over(of))
    counts = counts.withColumnRenamed("_range", "_in")
    inside = Window.partitionBy("_range", group).orderBy(*by[1:])
    placed = dealt.withColumn("_at", F.row_number().over(inside) - 1)
    met = placed.join(counts, (F.col("_range") == F.col("_in")) & F.col(group).eqNullSafe(F.col("_of")))
    return met.withColumn("_pos", F.col("_before") + F.col("_at")).drop("_range", "_in", "_of", "_here", "_before", "_at")


def _with_siblings(nodes: DataFrame) -> DataFrame:
    """nodes (_group, _pos, _n, _h) with ``_run``, ``_slot``, and the digests of the run before and after the node, ``_left`` and ``_right``."""
    near = "OVER (PARTITION BY _group, _run ORDER BY _slot)"
    before = [f"CASE WHEN _slot >= {k} THEN lag(_h, {k}) {near} END" for k in range(FANOUT - 1, 0, -1)]
    after = [f"CASE WHEN _slot + {k} < least({FANOUT}, _n - _run * {FANOUT}) THEN lead(_h, {k}) {near} END" for k in range(1, FANOUT)]
    nodes = nodes.withColumns({"_run": F.expr(f"_pos div {FANOUT}"), "_slot": F.expr(f"_pos % {FANOUT}")})
    return nodes.withColumns({"_left": F.expr(f"concat_ws('', {', '.join(before)})"), "_right": F.expr(f"concat_ws('', {', '.join(after)})")})


def _levels(nodes: DataFrame) -> list[DataFrame]:
    """The levels from nodes up, with siblings; on each, the groups that still have a node to hash or have just come to their last one. First children hash their runs."""
    levels = [_with_siblings(nodes)]
    most = nodes.agg(F.max("_n")).first()[0] or 0
    while most > 1:
        narrow = levels[-1] if len(levels) > 1 else _with_siblings(nodes.select("_group", "_pos", "_n", "_h"))
        parents = narrow.where("_n > 1 AND _slot = 0").selectExpr("_group", "_run AS _pos", f"(_n + {FANOUT - 1}) div {FANOUT} AS _n", "sha2(concat(_h, _right), 256) AS _h")
        levels.append(c.durable(_with_siblings(parents)))
        most = -(-most // FANOUT)
    return levels


def _proofs(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The rows of the lowest level with ``_path``: (left, right) siblings from their own level to the root. ``tops`` has the path of each group's last node."""
    found = None
    for nodes in reversed(levels):
        names = [x for x in nodes.columns if x not in ("_run", "_slot", "_left", "_right")]
        done = nodes.where("_n = 1").join(tops, F.expr("_group <=> _top")).selectExpr(*names, "_top_path AS _path", "_top_root AS _subroot")
        if found is not None:
            above = found.selectExpr("_group AS _over", "_pos AS _place", "_path AS _above", "_subroot")
            met = nodes.where("_n > 1").join(above, F.expr("_group <=> _over AND _run = _place"))
            done = met.selectExpr(*names, "concat(array(struct(_left AS left, _right AS right)), _above) AS _path", "_subroot").unionByName(done)
        found = done
    return found


def merkle_manifest(rows: DataFrame, group_col: str, order_col: str, leaf_col: str) -> DataFrame:
    """rows with ``position`` in the group (from 0), ``path`` array<struct<left, right>> from the leaf to the root, ``subroot`` and ``root``.

    ``leaf_col`` has the leaf digests as hexadecimal text (``field_digest``). left and right are
    the joined digests of the siblings on either side; ``fold`` puts a leaf and its path together again.
    """
    sealed = c.Sealed(rows)
    leaves = sealed.df.withColumns({"_group": F.col(sealed[group_col]).cast("string"), "_key": F.col(sealed[order_col]), "_h": F.col(sealed[leaf_col])})
    leaves = c.durable(leaves)  # so that dealing ranges does not digest all texts twice
    leaves = c.durable(_positioned(leaves, "_group", ["_key", "_h"]).drop("_key"))
    levels = _levels(leaves)
    ends = leaves.where("_n = 1").selectExpr("'' AS _all", "_group AS _name", "_h")
    for nodes in levels[1:]:
        ends = ends.unionByName(nodes.where("_n = 1").selectExpr("'' AS _all", "_group AS _name", "_h"))
    ends = c.durable(_positioned(ends, "_all", ["_name"])).withColumnRenamed("_all", "_group")
    top = _levels(ends)
    root = (top[-1].where("_n = 1").select("_h").first() or [None])[0]
    apex = rows.sparkSession.range(1).selectExpr("'' AS _top", "CAST(array() AS array<struct<left:string,right:string>>) AS _top_path", "'' AS _top_root")  # one row
    tops = _proofs(top, apex).selectExpr("_name AS _top", "_path AS _top_path", "_h AS _top_root")
    found = _proofs(levels, c.durable(tops))
    added = {"position": F.col("_pos"), "path": F.col("_path"), "subroot": F.col("_subroot"), "root": F.lit(root).cast("string")}
    return sealed.reopen(found, added=added)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda below, at: F.sha2(F.concat(at["left"], below, at["right"]), 256))


def proof_digest(path: Column) -> Column:
    """Hexadecimal SHA-256 of all siblings on the path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda at: F.concat(at["left"], at["right"])), ""), 256)


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = c.read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    named = [F.col(x) for x in ("doc_id", "source", "lang", "n_chars")]
    leaf = field_digest(*named, F.col("text"))
    changed = field_digest(*named, c.ascii_lower(F.col("text")))
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    leaves = docs.select("doc_id", "source", leaf.alias("leaf"), F.when(tampered, changed).alias("changed"))
    found = merkle_manifest(leaves, "source", "doc_id", "leaf").withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
         text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS small,
         xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
               lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, z: CASE WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END),
               4294967295::BIGINT), 4294967295::BIGINT) AS crc
  FROM documents
), l AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || CASE WHEN crc % 5 = 0 THEN coalesce(strlen(small) || ':' || small, '-') ELSE coalesce(strlen(text) || ':' || text, '-') END) AS claimed
  FROM d
), leaf AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l
), node AS (
  SELECT source, 0 AS level, pos, n, leaf AS h FROM leaf
  UNION ALL
  SELECT source, level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM node WHERE n > 1 GROUP BY source, level, pos // 16, n
), sub AS (
  SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM node WHERE n = 1
), top AS (
  SELECT 0 AS level, pos, n, h FROM sub
  UNION ALL
  SELECT level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 16, n
), below AS (
  SELECT e.doc_id, x.level, coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos < e.pos // (16 ** x.level)::BIGINT), '') AS lft,
         coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos > e.pos // (16 ** x.level)::BIGINT), '') AS rgt
  FROM leaf e JOIN node x ON e.source IS NOT DISTINCT FROM x.source AND x.n > 1 AND e.pos // (16 ** (x.level + 1))::BIGINT = x.pos // 16
  GROUP BY ALL
), above AS (
  SELECT e.source, 1000 + x.level AS level, coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos < e.pos // (16 ** x.level)::BIGINT), '') AS lft,
         coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos > e.pos // (16 ** x.level)::BIGINT), '') AS rgt
  FROM sub e JOIN top x ON x.n > 1 AND e.pos // (16 ** (x.level + 1))::BIGINT = x.pos // 16
  GROUP BY ALL
), step AS (
  SELECT doc_id, lft, rgt, row_number() OVER (PARTITION BY doc_id ORDER BY level) AS k
  FROM (SELECT * FROM below UNION ALL SELECT e.doc_id, a.level, a.lft, a.rgt FROM leaf e JOIN above a ON e.source IS NOT DISTINCT FROM a.source)
), fold AS (
  SELECT doc_id, 0::BIGINT AS k, claimed AS h FROM leaf
  UNION ALL
  SELECT f.doc_id, f.k + 1, sha256(s.lft || f.h || s.rgt) FROM fold f JOIN step s ON f.doc_id = s.doc_id AND s.k = f.k + 1
), proof AS (
  SELECT doc_id, string_agg(lft || rgt, '' ORDER BY k) AS all_of FROM step GROUP BY doc_id
)
SELECT e.doc_id, e.leaf, s.h AS subroot, r.h AS root, sha256(coalesce(p.all_of, '')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM leaf e JOIN sub s ON e.source IS NOT DISTINCT FROM s.source CROSS JOIN (SELECT h FROM top WHERE n = 1) r
LEFT JOIN proof p USING (doc_id) JOIN (SELECT doc_id, arg_max(h, k) AS h FROM fold GROUP BY doc_id) f USING (doc_id)
"""
