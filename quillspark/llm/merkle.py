"""Merkle manifest of a dataset: a digest for each row, tree and whole, and the proof that ties a row to the whole.

Rows become leaves in the order of a key within their tree (a source), trees in the order of their names. While several
nodes remain, every FANOUT consecutive ones become the digest of their digests; the last run may be short, even of one.

Superblocks: nodes are grouped by index // FANOUT ** LEVELS, so a group has at most that many rows whatever the size
of a tree, and one group collapses LEVELS levels at once. Its root is a node of the next round. On the way down each
superblock is met by the one row that holds the proof of its root, and a node's proof is its own steps followed by
those. Digests travel, texts don't.

Defined cases: a null value is the mark ``-``, an empty one is ``0:``, so they differ; rows without a tree are a tree of their
own, before all others; rows of equal keys follow their leaf digests, and equal rows are leaves each; a tree of one leaf is
that leaf; an empty table gives no rows. Further columns take no part.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm import scratch
from quillspark.llm.letters import small_letters
from quillspark.operators.rules import numbered

FANOUT, LEVELS = 16, 2
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = "array<struct<left string, right string>>"


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(columns: list[Column]) -> Column:
    """Digest of a row: of each value its length in bytes, a colon and the value as text, or a dash for null."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def folded(start: Column, steps: Column) -> Column:
    """The root that a leaf and the steps of its proof lead to."""
    return F.aggregate(steps, start, lambda x, s: F.sha2(F.concat(s["left"], x, s["right"]), 256))


def depth(n: int, fanout: int = FANOUT) -> int:
    """Levels above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def _levels(digests: list[str], n: int, fanout: int, levels: int) -> list[list[str]]:
    """Nodes of a superblock, level by level, as far as its tree of n nodes is not one node before."""
    out = [digests]
    for _ in range(min(levels, depth(n, fanout))):
        below = out[-1]
        out.append([_hex("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return out


def _collapse(fanout: int, levels: int):
    def collapse(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_i")
        n = int(rows["_n"].iat[0])
        made = _levels(rows["_digest"].tolist(), n, fanout, levels)
        above = -(-n // fanout ** (len(made) - 1))
        return pd.DataFrame({"_tree": [rows["_tree"].iat[0]], "_i": [int(rows["_i"].iat[0]) // fanout**levels], "_n": [above], "_digest": made[-1]})

    return collapse


def _descend(fanout: int, levels: int, columns: list[str]):
    def descend(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_i")
        made = _levels(rows["_digest"].tolist(), int(rows["_n"].iat[0]), fanout, levels)
        rest = [(s["left"], s["right"]) for s in above["_steps"].iat[0]]
        steps = []
        for at in range(len(rows)):
            own = []
            for nodes in made[:-1]:
                begin = at - at % fanout
                own.append(("".join(nodes[begin:at]), "".join(nodes[at + 1 : begin + fanout])))
                at //= fanout
            steps.append([{"left": a, "right": b} for a, b in own + rest])
        return rows[columns].assign(_steps=steps, _subroot=above["_subroot"].iat[0], _root=above["_root"].iat[0])

    return descend


def _bucket(fanout: int, levels: int) -> Column:
    return F.floor(F.col("_i") / F.lit(fanout**levels)).cast("long").alias("_bucket")


def _rounds(nodes: DataFrame, most: int, fanout: int, levels: int) -> list[DataFrame]:
    """The nodes of each round from the leaves up; the last has one node a tree."""
    out = [nodes]
    for _ in range(-(-depth(most, fanout) // levels)):
        above = out[-1].select("_tree", "_i", "_n", "_digest").groupBy("_tree", _bucket(fanout, levels)).applyInPandas(_collapse(fanout, levels), "_tree string, _i long, _n long, _digest string")
        out.append(scratch.saved(above, "superblocks"))
    return out


def _proofs(rounds: list[DataFrame], tops: DataFrame, fanout: int, levels: int) -> DataFrame:
    """tops (_tree, _i, _steps, _subroot, _root) carried down to the first round's rows, a superblock at a time."""
    for nodes in reversed(rounds[:-1]):
        columns = [c for c in nodes.columns if c != "_n"]
        schema = ", ".join(f"{c} {nodes.schema[c].dataType.simpleString()}" for c in columns)
        below = nodes.groupBy("_tree", _bucket(fanout, levels)).cogroup(tops.select(*tops.columns, F.col("_i").alias("_bucket")).groupBy("_tree", "_bucket"))
        tops = below.applyInPandas(_descend(fanout, levels, columns), f"{schema}, _steps {_STEPS}, _subroot string, _root string")
    return tops


def proofs(df: DataFrame, columns: list[str], tree: str, order: str, carried: dict[str, Column] | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(order, leaf, subroot, root, steps, carried...) of each row; steps hold the digests left and right of its node at each level, from the leaf up."""
    carried = carried or {}
    rows = df.select(F.coalesce(F.concat(F.lit("v"), F.col(tree).cast("string")), F.lit("-")).alias("_tree"), F.col(order).alias("_key"), leaf([F.col(c) for c in columns]).alias("_digest"), *[c.alias(f"_x{k}") for k, c in enumerate(carried.values())])
    placed = numbered(rows, ["_tree", "_key", "_digest"], "_number")
    sizes = placed.groupBy("_tree").agg(F.min("_number").alias("_first"), F.count("*").alias("_n"))
    leaves = scratch.saved(placed.join(sizes, "_tree").select("_tree", (F.col("_number") - F.col("_first")).alias("_i"), "_n", "_digest", "_key", *[f"_x{k}" for k in range(len(carried))]), "leaves")
    most = leaves.agg(F.max("_n")).first()[0] or 0
    within = _rounds(leaves, most, fanout, levels)
    tops = within[-1].select("_tree", "_digest")
    trees = tops.count()
    subroots = scratch.saved(numbered(tops.select(F.lit("").alias("_tree"), F.col("_tree").alias("_name"), "_digest"), ["_name"], "_number").select("_tree", (F.col("_number") - 1).alias("_i"), F.lit(trees).cast("long").alias("_n"), "_digest", "_name"), "subroots")
    among = _rounds(subroots, trees, fanout, levels)
    nothing = F.array().cast(_STEPS).alias("_steps")
    if len(among) == 1:  # one tree: its root is that of all
        named = subroots.select(F.col("_name").alias("_tree"), F.lit(0).cast("long").alias("_i"), nothing, F.col("_digest").alias("_subroot"), F.col("_digest").alias("_root"))
    else:
        whole = among[-1].select("_tree", "_i", nothing, F.col("_digest").alias("_subroot"), F.col("_digest").alias("_root"))
        named = _proofs(among, whole, fanout, levels).select(F.col("_name").alias("_tree"), F.lit(0).cast("long").alias("_i"), "_steps", F.col("_digest").alias("_subroot"), "_root")
        named = scratch.saved(named, "subroot-proofs")
    if len(within) == 1:  # every tree is one leaf
        out = leaves.drop("_n").join(named.drop("_i"), "_tree")
    else:
        out = _proofs(within, named, fanout, levels)
    names = [F.col(f"_x{k}").alias(name) for k, name in enumerate(carried)]
    return out.select(F.col("_key").alias(order), F.col("_digest").alias("leaf"), F.col("_subroot").alias("subroot"), F.col("_root").alias("root"), F.col("_steps").alias("steps"), *names)


def verified(proved: DataFrame, leaf: Column) -> DataFrame:
    """proofs() with proof_sha256, the root that a leaf leads to, and whether it is the manifest's."""
    siblings = F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "")
    out = proved.withColumns({"proof_sha256": F.sha2(siblings, 256), "folded_root": folded(leaf, F.col("steps"))})
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def digests(docs: DataFrame) -> DataFrame:
    """The manifest of documents, and its check against rows of which every fifth by hash has the letters A to Z of its text lowered."""
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = F.when(odd, leaf([small_letters(F.col(c)) if c == "text" else F.col(c) for c in COLUMNS]))
    out = verified(proofs(docs, list(COLUMNS), "source", "doc_id", {"tampered": other}), F.coalesce("tampered", "leaf"))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _level(name: str, below: str) -> str:
    """SQL of the nodes above those of below, with what stands left and right of each node below in its run."""
    w = "(PARTITION BY t, i // 16 ORDER BY i ROWS BETWEEN {})"
    return f"""{below}s AS (SELECT t, i, d, n, CASE WHEN n > 1 THEN coalesce(string_agg(d, '') OVER {w.format("UNBOUNDED PRECEDING AND 1 PRECEDING")}, '') END AS l, CASE WHEN n > 1 THEN coalesce(string_agg(d, '') OVER {w.format("1 FOLLOWING AND UNBOUNDED FOLLOWING")}, '') END AS r FROM {below}),
{name} AS (SELECT t, i // 16 AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE any_value(d) END AS d, CAST(ceil(any_value(n) / 16) AS BIGINT) AS n FROM {below} GROUP BY t, i // 16)"""


_DEEP, _WIDE = 4, 2  # levels within and among trees in SQL: up to 65,536 rows a tree and 256 trees
_LEAF = "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in COLUMNS) + ")"
_OTHER = _LEAF.replace("CAST(text AS VARCHAR)", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
#: crc32 of a text of ASCII letters, a byte and its eight shifts at a time.
CRC = "xor(4294967295, list_reduce(flatten([[CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split({}, '')]), lambda a, v: CASE WHEN v >= 0 THEN xor(a, v) ELSE xor(a >> 1, (a & 1) * 3988292384) END, CAST(4294967295 AS BIGINT)))"
_STEPS_SQL = [f"n{k}s" for k in range(_DEEP)] + [f"m{k}s" for k in range(_WIDE)]


ORACLE_SQL = f"""
WITH leaves AS (SELECT doc_id, coalesce('v' || source, '-') AS t, {_LEAF} AS d, CASE WHEN {CRC.format("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {_OTHER} END AS other FROM documents),
n00 AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, d) - 1 AS i, count(*) OVER (PARTITION BY t) AS n FROM leaves),
n0 AS (SELECT t, i, d, n FROM n00), {", ".join(_level(f"n{k + 1}", f"n{k}") for k in range(_DEEP))},
m0 AS (SELECT '' AS t, row_number() OVER (ORDER BY t) - 1 AS i, d, count(*) OVER () AS n, t AS name FROM n{_DEEP}), {", ".join(_level(f"m{k + 1}", f"m{k}") for k in range(_WIDE))},
f0 AS (SELECT doc_id, n00.d AS leaf, coalesce(other, n00.d) AS x, m0.d AS subroot, m{_WIDE}.d AS root, {", ".join(f"{s}.l AS l{k}, {s}.r AS r{k}" for k, s in enumerate(_STEPS_SQL))}
  FROM n00 JOIN m0 ON m0.name = n00.t, m{_WIDE} {" ".join(f"LEFT JOIN n{k}s ON n{k}s.t = n00.t AND n{k}s.i = n00.i // {16**k}" for k in range(_DEEP))} {" ".join(f"LEFT JOIN m{k}s ON m{k}s.i = m0.i // {16**k}" for k in range(_WIDE))}),
{", ".join(f"f{k + 1} AS (SELECT * REPLACE (CASE WHEN l{k} IS NULL THEN x ELSE sha256(l{k} || x || r{k}) END AS x) FROM f{k})" for k in range(len(_STEPS_SQL)))}
SELECT doc_id, leaf, subroot, root, sha256({" || ".join(f"coalesce(l{k} || r{k}, '')" for k in range(len(_STEPS_SQL)))}) AS proof_sha256, x AS folded_root, x = root AS verified FROM f{len(_STEPS_SQL)}
"""
