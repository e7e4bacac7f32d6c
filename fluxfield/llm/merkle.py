"""A Merkle manifest of a table: a digest of every row, trees over them, and a proof for each row.

A leaf is the digest of a row's fields. The leaves of a group (a language, say) in order of their ids are hashed in runs
of `fanout` until one digest is left, its subroot; the subroots in order of their groups are hashed likewise to the root.

While a parent is hashed it keeps a copy of the hash state before each child's slot. A changed child is folded by going
on from the copy for its slot with the new digest and the siblings right of it only: what is left of it is in the state
already. Hash states cannot leave a process, so trees are worked out in blocks of consecutive nodes, whole subtrees of
some thousand leaves, each in one task: up, blocks to the nodes of the next tier until each group has one; down, every
node gets its ladder, the siblings left and right of it and of all above it, from which a task takes up the states above
its block once for all leaves in it. Tiers are a few (each divides the nodes by some thousand), whatever the number
of rows, and no task has more than a block, however large a group is.

Texts are read once and never shuffled: only digests and ids are. Rows are ordered by group, id and digest in a range
sort that has a row's number as its last key, so one group, id or repeated row of any size is dealt over many tasks.

Null fields are `-`; the null group comes first, and null ids come first in a group. Rows with one id are ordered by
their digests. Integers of any size are decimal. Empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxfield.operators.graph import dense_index

from .common import sized, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 2
#: Nodes of a block, at most; a block is the largest power of the fanout within it.
BLOCK_NODES = 4096
#: The one group of the tree over groups.
TOP = ""


def leaf_digest(values: list[Column]) -> Column:
    """Of each value its bytes in UTF-8, a colon and itself, or - if it is null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def block_levels(fanout: int) -> int:
    """Levels of a full block."""
    if fanout < 2:
        raise ValueError("the fanout is less than 2")
    levels = 1
    while fanout ** (levels + 1) <= BLOCK_NODES:
        levels += 1
    return levels


def height(n: int, fanout: int) -> int:
    """Levels above n nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


class Subtree:
    """The levels above some consecutive nodes, with the states that parents keep."""

    def __init__(self, nodes: list[str], levels: int, fanout: int) -> None:
        self.fanout, self.states, self.lefts, self.rights = fanout, [], [], []
        for _ in range(levels):
            states, lefts, rights, above = [], [], [], []
            for at in range(0, len(nodes), fanout):
                run, state = nodes[at : at + fanout], hashlib.sha256()
                for k, child in enumerate(run):
                    states.append(state.copy())
                    lefts.append("".join(run[:k]))
                    rights.append("".join(run[k + 1 :]))
                    state.update(child.encode())
                above.append(state.hexdigest())
            self.states.append(states)
            self.lefts.append(lefts)
            self.rights.append(rights)
            nodes = above
        self.root = nodes[0]

    def ladder(self, k: int) -> tuple[list[str], list[str]]:
        """Siblings left and right of node k and of those above it, a level at a time."""
        left, right = [], []
        for lefts, rights in zip(self.lefts, self.rights, strict=True):
            left.append(lefts[k])
            right.append(rights[k])
            k //= self.fanout
        return left, right

    def fold(self, k: int, digest: str) -> str:
        """The root if node k had this digest."""
        for states, rights in zip(self.states, self.rights, strict=True):
            digest = resumed(states[k], digest, rights[k])
            k //= self.fanout
        return digest


def resumed(state, digest: str, right: str) -> str:
    after = state.copy()
    after.update((digest + right).encode())
    return after.hexdigest()


def _levels(n: int, fanout: int) -> int:
    """Levels of a block in a group of n nodes: up to the one left, or a full block's."""
    full = block_levels(fanout)
    return height(n, fanout) if n <= fanout**full else full


def _raise(fanout: int) -> Callable:
    def block(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        n, leaves = rows.column("n")[0].as_py(), rows.column("leaf").to_pylist()
        root = Subtree(leaves, _levels(n, fanout), fanout).root
        lists = [pa.array([rows.column(c).to_pylist()], pa.list_(rows.schema.field(c).type)) for c in ("id", "leaf", "claim")]
        return pa.Table.from_arrays([*(rows.column(c).slice(0, 1) for c in ("group", "n", "block")), pa.array([root]), *lists], ["group", "n", "block", "digest", "ids", "leaves", "claims"])

    return block


def _climb(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """Tiers of blocks over nodes (group, n, pos, leaf, id, claim), n being the nodes of the group in the tier."""
    size, tiers = fanout ** block_levels(fanout), []
    while True:
        kind = nodes.schema["id"].dataType.simpleString()
        schema = f"group string, n bigint, block bigint, digest string, ids array<{kind}>, leaves array<string>, claims array<string>"
        placed = nodes.withColumn("block", F.expr(f"pos div {size}L"))
        tiers.append(stored(placed.groupBy("group", "block").applyInArrow(_raise(fanout), schema), "tier"))
        more = tiers[-1].where(F.col("n") > size)
        if more.isEmpty():
            return tiers
        none = F.lit(None).cast("string")
        nodes = more.select("group", F.ceil(F.col("n") / F.lit(size)).cast("long").alias("n"), F.col("block").alias("pos"), F.col("digest").alias("leaf"), none.alias("id"), none.alias("claim"))


def _tops(tiers: list[DataFrame], fanout: int) -> DataFrame:
    """(group, digest): each group's last node."""
    tops = [t.where(F.col("n") <= fanout ** block_levels(fanout)).select("group", "digest") for t in tiers]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out


def _lower(fanout: int) -> Callable:
    def ladders(block: pa.Table, above: pa.Table) -> pa.Table:
        b, up = block.to_pylist()[0], above.to_pylist()[0]
        tree = Subtree(b["leaves"], _levels(b["n"], fanout), fanout)
        first, rows = b["block"] * fanout ** block_levels(fanout), []
        for k in range(len(b["leaves"])):
            left, right = tree.ladder(k)
            rows.append({"group": b["group"], "pos": first + k, "lefts": left + up["lefts"], "rights": right + up["rights"]})
        return pa.Table.from_pylist(rows, LADDER)

    return ladders


LADDER = pa.schema([("group", pa.string()), ("pos", pa.int64()), ("lefts", pa.list_(pa.string())), ("rights", pa.list_(pa.string()))])
LADDER_SCHEMA = "group string, pos bigint, lefts array<string>, rights array<string>"


def _under(tier: DataFrame, ladders: DataFrame, work: Callable, schema: str) -> DataFrame:
    """work(block, ladder) over the blocks of a tier, one at a time, each with the ladder (group, block, ...) above it."""
    key = ["group", "block"]
    return tier.drop("digest").groupBy(*key).cogroup(stored(ladders, "ladders").groupBy(*key)).applyInArrow(work, schema)


def _descend(tiers: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """(group, block, lefts, rights) of the lowest tier's blocks, from the ladders (group, lefts, rights) of groups."""
    size, above = fanout ** block_levels(fanout), None
    for tier in reversed(tiers):
        own = tier.where(F.col("n") <= size).select("group", "block").join(tops.hint("merge"), "group")
        ladders = own if above is None else own.unionByName(above)
        if tier is tiers[0]:
            return ladders
        above = _under(tier.drop("ids", "claims"), ladders, _lower(fanout), LADDER_SCHEMA).withColumnRenamed("pos", "block")


def _prove(fanout: int) -> Callable:
    def prove(block: pa.Table, above: pa.Table) -> pa.Table:
        b, up = block.select(["n", "leaves", "claims", "group"]).to_pylist()[0], above.to_pylist()[0]
        tree = Subtree(b["leaves"], _levels(b["n"], fanout), fanout)
        upper = [(hashlib.sha256(left.encode()), right) for left, right in zip(up["lefts"], up["rights"], strict=True)]
        rest = "".join(left + right for left, right in zip(up["lefts"], up["rights"], strict=True))
        proofs, folded = [], []
        for k, leaf in enumerate(b["leaves"]):
            within = "".join(left + right for left, right in zip(*tree.ladder(k), strict=True))
            proofs.append(hashlib.sha256((within + rest).encode()).hexdigest())
            digest = tree.fold(k, b["claims"][k] or leaf)
            for state, right in upper:
                digest = resumed(state, digest, right)
            folded.append(digest)
        ids, leaves = (block.column(c).combine_chunks().flatten() for c in ("ids", "leaves"))
        return pa.Table.from_arrays([ids, leaves, pa.array([b["group"]] * len(proofs), pa.string()), pa.array(proofs), pa.array(folded)], ["id", "leaf", "group", "proof_sha256", "folded_root"])

    return prove


def _placed(rows: DataFrame) -> DataFrame:
    """rows with pos, their place in their group, and n, the rows of the group."""
    order = ["group", "id", "leaf", "row"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    # Written once, so that ranges (chosen from samples) cannot differ between the counts and the places.
    ranged = stored(ranged, "leaves").withColumn("part", F.shiftright("place", 33))
    counts = ranged.groupBy("group", "part").agg(F.count("*").alias("here"), F.min("place").alias("first"))
    group = Window.partitionBy("group")
    earlier = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each group and each task that has some of it.
    counts = counts.select("group", "part", "first", F.sum("here").over(group).alias("n"), F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("before"))
    joined = ranged.join(sized(counts, "places"), ["group", "part"])
    return joined.select("group", "n", (F.col("before") + F.col("place") - F.col("first")).alias("pos"), "id", "leaf", "claim")


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, claims: dict[str, Column] | None = None, fanout: int = FANOUT, id_col: str = "doc_id", group_col: str = "lang") -> DataFrame:
    """Returns id, group, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    claims are other values of some fields, as a holder of the row presents them: folded_root is what the row with these
    and its siblings' digests give, and verified whether that is the root. proof_sha256 is the digest of the siblings.
    """
    claims = claims or {}
    values = [F.col(c) for c in fields]
    claimed = [claims.get(c, F.col(c)) for c in fields]
    changed = F.lit(False)
    for c in claims:
        changed = changed | ~claims[c].cast("string").eqNullSafe(F.col(c).cast("string"))
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    rows = docs.select(
        group.alias("group"),
        F.col(id_col).alias("id"),
        leaf_digest(values).alias("leaf"),
        F.when(changed, leaf_digest(claimed)).alias("claim"),
        F.monotonically_increasing_id().alias("row"),
    )
    tiers = _climb(_placed(stored(rows, "digests")), fanout)
    subroots = dense_index(_tops(tiers, fanout), [F.col("group")], "pos")
    subroots = stored(subroots, "subroots")
    n, none = subroots.count(), F.lit(None).cast("string")
    over = subroots.select(F.lit(TOP).alias("group"), F.lit(n).cast("long").alias("n"), "pos", F.col("digest").alias("leaf"), F.col("group").alias("id"), none.alias("claim"))
    over_tiers = _climb(over, fanout)
    none_above = _tops(over_tiers, fanout).select("group", *[F.array().cast("array<string>").alias(c) for c in ("lefts", "rights")])
    first = _under(over_tiers[0].drop("ids", "claims"), _descend(over_tiers, none_above, fanout), _lower(fanout), LADDER_SCHEMA)
    tops = first.drop("group").join(subroots.hint("merge"), "pos").select("group", "lefts", "rights")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, leaf string, group string, proof_sha256 string, folded_root string"
    proved = _under(tiers[0], _descend(tiers, stored(tops, "tops"), fanout), _prove(fanout), schema)
    root = F.broadcast(_tops(over_tiers, fanout).select(F.col("digest").alias("root")))  # one row
    given = sized(subroots.select("group", F.col("digest").alias("subroot")), "given")
    return (
        proved.join(given, "group")
        .join(root)
        .select(
            F.col("id").alias(id_col),
            F.when(F.col("group") != "", F.substr("group", F.lit(2))).alias(group_col),
            "leaf",
            "subroot",
            "root",
            "proof_sha256",
            "folded_root",
            (F.col("folded_root") == F.col("root")).alias("verified"),
        )
    )


ORACLE_SQL = r"""
WITH RECURSIVE k AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)) AS crcs),
d AS MATERIALIZED (
  SELECT *, CASE WHEN xor(4294967295, list_reduce(list_transform(range(length(doc_id::VARCHAR)), lambda i: ascii((doc_id::VARCHAR)[i + 1])),
    lambda c, b: xor(crcs[(xor(c, b) & 255) + 1], c >> 8), 4294967295)) % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS claimed FROM documents, k),
h AS MATERIALIZED (
  SELECT doc_id, lang, sha256(a || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') || z) AS leaf,
         sha256(a || coalesce(octet_length(encode(claimed::VARCHAR)) || ':' || claimed, '-') || z) AS claim
  FROM (SELECT *, coalesce(length(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
               || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS a, coalesce(octet_length(encode(text)) || ':' || text, '-') AS z FROM d)),
leaves AS MATERIALIZED (
  SELECT row_number() OVER () AS id, doc_id, coalesce('=' || lang, '') AS lang, leaf, claim, count(*) OVER (PARTITION BY lang) AS n,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM h),
t(lang, lvl, pos, n, h) AS MATERIALIZED (
  SELECT lang, 0, pos, n, leaf FROM leaves
  UNION ALL
  SELECT lang, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY lang, lvl, pos // 2, n),
tops AS MATERIALIZED (SELECT lang, lvl AS height, h, row_number() OVER (ORDER BY lang) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u(lvl, pos, n, h) AS MATERIALIZED (
  SELECT 0, pos, n, h FROM tops
  UNION ALL
  SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY lvl, pos // 2, n),
root AS MATERIALIZED (SELECT h AS root, lvl AS height FROM u WHERE n = 1),
s AS MATERIALIZED (
  SELECT l.id, x.lvl, (l.pos >> x.lvl) & 1 AS odd, coalesce(t.h, '') AS sibling
  FROM leaves l JOIN tops USING (lang) JOIN (SELECT range AS lvl FROM range(64)) x ON x.lvl < tops.height
  LEFT JOIN t ON t.lang = l.lang AND t.lvl = x.lvl AND t.pos = xor(l.pos >> x.lvl, 1)
  UNION ALL
  SELECT l.id, tops.height + x.lvl, (tops.pos >> x.lvl) & 1, coalesce(u.h, '')
  FROM leaves l JOIN tops USING (lang), root JOIN (SELECT range AS lvl FROM range(64)) x ON x.lvl < root.height
  LEFT JOIN u ON u.lvl = x.lvl AND u.pos = xor(tops.pos >> x.lvl, 1)),
f(id, lvl, h) AS (
  SELECT id, 0, claim FROM leaves
  UNION ALL
  SELECT f.id, f.lvl + 1, sha256(CASE WHEN odd = 1 THEN sibling || f.h ELSE f.h || sibling END) FROM f JOIN s ON s.id = f.id AND s.lvl = f.lvl),
proofs AS (SELECT id, sha256(string_agg(sibling, '' ORDER BY lvl)) AS proof FROM s GROUP BY id),
folds AS (SELECT id, max_by(h, lvl) AS folded FROM f GROUP BY id)
SELECT doc_id, CASE WHEN l.lang <> '' THEN l.lang[2:] END AS lang, leaf, tops.h AS subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM leaves l JOIN tops ON tops.lang = l.lang JOIN folds USING (id) LEFT JOIN proofs USING (id), root
"""
