"""A Merkle manifest of a dataset, and proofs that a row belongs to it.

Each row is a leaf.  Inside its group, leaves are ranked by their id; while
more than one node remains, every ``FAN`` consecutive ones become the hash of
their digests.  The groups' last nodes, by group, are the leaves of one more
tree, whose last node is the root.

Every node is labelled with its group, its level and the interval [lo, hi) of
the leaf ranks it covers, nested in its parent's.  Going down from the root,
the nodes of a level are joined with those of the level above on the bucket
of ranks, where the parent's interval contains the node's; a parent brings
what its own ancestors brought.  The difference of the two intervals, taken
from the parent's children, is the node's siblings.

Only digests and ids move, never a text.  Ranks come from a range partitioning
by group, id and digest, so a group with most rows spreads over all tasks; a
level has an eighth of the rows of the one below it, and is written to the
checkpoint folder.  The driver gets two counts a tree.

Defined results: a null value is ``-``; rows of no group are one group and
come first; null ids come first in their group and are not tampered with; rows
that share an id are ordered by digest, equal rows in any order; an empty
table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Children of a node.
FAN = 8
#: The columns that a leaf commits to, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows that one task puts in order, about.
ROWS_OF_TASK = 500_000
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts put together, as lowercase hex."""
    return F.sha2(F.concat(*(p.cast("binary") for p in parts)), 256)


def field(value: Column) -> Column:
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def _hex(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def leaves(docs: DataFrame, group: str = "lang", fields: tuple[str, ...] = FIELDS, tampered: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, grp, digest, other): a row's digest, and that with the ``tampered`` columns in place of its own, null where that changes nothing.

    ``grp`` orders as the group does, null first.
    """
    own = digest(*(field(F.col(c)) for c in fields))
    other = digest(*(field((tampered or {}).get(c, F.col(c))) for c in fields))
    rows = docs.select("doc_id", F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0")).alias("grp"), own.alias("own"), other.alias("other"))
    return rows.select("doc_id", "grp", F.unhex("own").alias("digest"), F.when(F.col("own") != F.col("other"), F.unhex("other")).alias("other"))


def ranked(rows: DataFrame, *order: str) -> tuple[DataFrame, int, int]:
    """``rows`` (written) with lo, hi and n (rows of the group), ranked inside ``grp`` by ``order``; the number of rows; the most of a group."""
    count = rows.count()
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // ROWS_OF_TASK))
    numbered = checkpointed(rows.repartitionByRange(parts, "grp", *order).sortWithinPartitions("grp", *order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    runs = numbered.groupBy("grp", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = checkpointed(runs.select("grp", "part", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"), F.sum("rows").over(Window.partitionBy("grp")).alias("n")))
    most = runs.agg(F.max("n")).first()[0] or 0
    rank = F.col("at") - F.col("first") + F.col("before")
    got = numbered.withColumn("part", part).join(runs, ["grp", "part"]).withColumn("lo", rank).withColumn("hi", rank + 1)
    return got.drop("part", "first", "before", "at"), count, most


def levels(rows: DataFrame, most: int) -> list[DataFrame]:
    """The nodes of every level (grp, n, lo, hi, digest, children), those of ``rows`` (ranked) first.

    A group ends where one node covers it.
    """
    out, width = [rows], 1
    while width < most:
        child = F.struct("lo", "hi", "digest")
        below = out[-1].where(F.col("n") > width)
        width *= FAN
        grown = below.groupBy("grp", F.floor(F.col("lo") / width).alias("bucket")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(child)).alias("children"))
        text = F.array_join(F.transform("children", lambda c: _hex(c["digest"])), "")
        grown = grown.select("grp", "n", F.col("children")[0]["lo"].alias("lo"), F.element_at("children", -1)["hi"].alias("hi"), F.unhex(digest(text)).alias("digest"), "children")
        out.append(checkpointed(grown))
    return out


def tops(tree: list[DataFrame]) -> DataFrame:
    """(grp, digest) of the node that covers each group whole."""
    out, width = None, 1
    for nodes in tree:
        whole = nodes.where((F.col("n") <= width) & (F.col("n") > width // FAN)).select("grp", "digest")
        out = whole if out is None else out.unionByName(whole)
        width *= FAN
    return out


def attached(tree: list[DataFrame], above: DataFrame) -> DataFrame:
    """The rows of the lowest level with ``path`` and the other columns of ``above`` (grp, path, ...).

    ``path`` has the siblings to the left and to the right at each level from
    the row's own upwards, digests put together; above a group's last node
    it goes on with that group's ``path`` in ``above``.
    """
    carried, parents = [c for c in above.columns if c != "grp"], None
    for k in reversed(range(len(tree))):
        width = FAN**k
        nodes = tree[k]
        got = nodes.where((F.col("n") <= width) & (F.col("n") > width // FAN)).join(above, "grp")
        if parents is not None:
            bucket = F.floor(F.col("lo") / (width * FAN))
            up = parents.select("grp", F.floor(F.col("lo") / (width * FAN)).alias("bucket"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"), F.col("children").alias("p_children"), *carried)
            inside = nodes.where(F.col("n") > width).withColumn("bucket", bucket).join(up, ["grp", "bucket"]).where((F.col("p_lo") <= F.col("lo")) & (F.col("hi") <= F.col("p_hi")))

            def side(keep):
                return F.aggregate(F.filter("p_children", keep), F.lit(b"").cast("binary"), lambda s, c: F.concat(s, c["digest"]))

            here = F.struct(side(lambda c: c["hi"] <= F.col("lo")).alias("left"), side(lambda c: c["lo"] >= F.col("hi")).alias("right"))
            inside = inside.withColumn("path", F.concat(F.array(here), F.col("path"))).select(*nodes.columns, *carried)
            got = got.select(*nodes.columns, *carried).unionByName(inside)
        parents = got
    return parents


def folded(start: Column, path: Column) -> Column:
    """The root that ``start`` (a digest, hex) leads to by the siblings of ``path``."""
    return F.aggregate(path, start, lambda s, p: digest(_hex(p["left"]), s, _hex(p["right"])))


def manifest(docs: DataFrame, group: str = "lang", fields: tuple[str, ...] = FIELDS, tampered: dict[str, Column] | None = None) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, path, proof_sha256, folded_root and verified.

    ``folded_root`` is worked out from the row's tampered digest, if it has
    one, and the siblings of the untampered tree.
    """
    rows = checkpointed(leaves(docs, group, fields, tampered).withColumn("number", F.monotonically_increasing_id()))
    rows, _, most = ranked(rows, "doc_id", "digest", "number")
    tree = levels(rows.drop("number"), most)
    subroots = checkpointed(tops(tree))
    forest, _, groups = ranked(subroots.select(F.col("grp").alias("member"), F.lit("").alias("grp"), "digest"), "member")
    crown = levels(forest, groups)
    root = tops(crown).select("grp", F.col("digest").alias("root"), F.array().cast("array<struct<left:binary,right:binary>>").alias("path"))
    above = attached(crown, root).select(F.col("member").alias("grp"), F.col("digest").alias("subroot"), "root", "path")
    got = attached(tree, above)
    siblings = F.aggregate("path", F.lit(""), lambda s, p: F.concat(s, _hex(p["left"]), _hex(p["right"])))
    out = got.select("doc_id", _hex(F.col("digest")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), _hex(F.col("root")).alias("root"), "path", digest(siblings).alias("proof_sha256"), _hex(F.coalesce("other", "digest")).alias("start"))
    out = out.withColumn("folded_root", folded(F.col("start"), F.col("path"))).withColumn("verified", F.col("folded_root") == F.col("root"))
    return out.select("doc_id", "leaf", "subroot", "root", "path", "proof_sha256", "folded_root", "verified")


def lower_cased(doc_id: Column, text: Column, every: int = 3) -> Column:
    """``text`` with its A-Z in lower case where ``every`` divides the CRC-32 of the id in decimal."""
    chosen = F.crc32(doc_id.cast("string").cast("binary")) % every == 0
    return F.when(chosen, F.translate(text.cast("string"), CAPITALS, SMALL)).otherwise(text.cast("string"))
