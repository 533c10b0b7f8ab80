"""A Merkle manifest of a table: a digest a row, a tree a group, a tree over the groups, proofs and their check.

Nodes of a level are numbered in their group. Every level is one equi-join of the nodes with themselves on computed
sibling numbers: the number XOR 1 in a binary tree, else the other slots of the node's run. A row knows then what
stands before and after it; the rows in slot zero give the next level. Each level is written to the shared
folder, so a lost executor costs that level's tasks only. No row number or digest passes through one task: the only things
that shrink to a single row are the tops of the trees.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import materialise
from pairloom.operators.ordered import ranked

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 8
STEP = "array<struct<before:binary,after:binary>>"


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def digest_of(*texts: Column) -> Column:
    """The sha256 of the texts one after another, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*texts).cast("binary"), 256))


def leaf(fields: Sequence[Column]) -> Column:
    """Digest of a row: every field as its length in bytes, a colon and its text, or ``-`` for NULL."""
    written = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return digest_of(*written)


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """``nodes(g, at, digest, carried)`` with ``before`` and ``after``: the digests of its run on either side of a node.

    A node asks for each of its possible siblings by number; numbers that nobody has (in a last, shorter run) stay unanswered. Keys
    are unique on the answering side, and the asking side has ``arity - 1`` rows a key, whatever the groups' sizes.
    """
    slot = F.col("at") % arity
    if arity == 2:
        wanted = F.array(F.col("at").bitwiseXOR(F.lit(1)))
    else:
        wanted = F.transform(F.sequence(F.lit(1), F.lit(arity - 1)), lambda o: F.col("at") - slot + (slot + o) % arity)
    asking = nodes.select("g", "at", "digest", "carried", F.posexplode(wanted).alias("nth", "sibling"))
    # digest and load travel once, with the first question
    own = F.when(F.col("nth") == 0, F.struct("digest", "carried")).alias("own")
    asking = asking.select("g", "at", "sibling", own)
    answers = nodes.select(F.col("g").alias("_g"), F.col("at").alias("_at"), F.col("digest").alias("_digest"))
    met = asking.join(answers, (F.col("g") == F.col("_g")) & (F.col("sibling") == F.col("_at")), "left")
    run = met.groupBy("g", "at").agg(
        F.first("own", ignorenulls=True).alias("own"),
        F.array_sort(F.collect_list(F.when(F.col("_at").isNotNull(), F.struct(F.col("_at").alias("at"), F.col("_digest").alias("digest"))))).alias("run"),
    )

    def side(test) -> Column:
        return F.unhex(F.array_join(F.transform(F.filter("run", test), lambda n: F.hex(n["digest"])), ""))

    return run.select(
        "g", "at", "own.digest", "own.carried", (F.size("run") == 0).alias("alone"),
        side(lambda n: n["at"] < F.col("at")).alias("before"), side(lambda n: n["at"] > F.col("at")).alias("after"),
    )


def top() -> Column:
    """A node that is alone in its whole group; a last run may hold one node too, but not number zero."""
    return F.col("alone") & (F.col("at") == 0)


def grow(leaves: DataFrame, arity: int = ARITY) -> list[DataFrame]:
    """The levels of the trees over ``leaves(g, at, digest, carried)``, lowest first; ends when each group has its top."""
    levels, nodes = [], leaves
    while True:
        level = materialise(with_siblings(nodes, arity), "merkle-level")
        levels.append(level)
        above = level.where((F.col("at") % arity == 0) & ~top())
        if above.isEmpty():
            return levels
        both = digest_of(hexed(F.col("before")), hexed(F.col("digest")), hexed(F.col("after")))
        nothing = F.lit(None).cast(leaves.schema["carried"].dataType)
        nodes = above.select("g", F.floor(F.col("at") / arity).cast("bigint").alias("at"), both.alias("digest"), nothing.alias("carried"))


def tops(levels: list[DataFrame]) -> DataFrame:
    out = None
    for level in levels:
        found = level.where(top()).select("g", "digest")
        out = found if out is None else out.unionByName(found)
    return out


def with_paths(levels: list[DataFrame], ends: DataFrame, arity: int) -> DataFrame:
    """The lowest level with ``path`` (what stands before and after at every step up) and ``ends``' other columns.

    ``ends`` has ``g``, the ``path`` that follows above the group's top, and whatever the rows shall know. Goes down level by
    level; a level's rows join their parents' by number, at most ``arity`` to one.
    """
    known = [c for c in ends.columns if c not in ("g", "path")]
    parents = None
    for level in reversed(levels):
        at_top = level.where(top()).join(ends, "g")
        rows = at_top.select("g", "at", "digest", "carried", "path", *known)
        if parents is not None:
            up = parents.select(F.col("g").alias("_g"), F.col("at").alias("_at"), F.col("path").alias("_path"), *known)
            below = level.where(~top()).join(up, (F.col("g") == F.col("_g")) & (F.floor(F.col("at") / arity) == F.col("_at")))
            step = F.array(F.struct("before", "after")).cast(STEP)
            rows = rows.unionByName(below.select("g", "at", "digest", "carried", F.concat(step, F.col("_path")).alias("path"), *known))
        parents = rows
    return parents


def proof(path: Column) -> Column:
    """All siblings' digests from the row up to the root, each step's from left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(hexed(s["before"]), hexed(s["after"]))), "")


def fold(digest: Column, path: Column) -> Column:
    """The root that a digest and the path beside it lead to, in lowercase hex."""
    return F.aggregate(path, hexed(digest), lambda h, s: F.sha2(F.concat(hexed(s["before"]), h, hexed(s["after"])).cast("binary"), 256))


def manifest(docs: DataFrame, claimed: Column | None = None, fields: Sequence[str] = FIELDS, group: str = "lang", order: str = "doc_id", arity: int = ARITY) -> DataFrame:
    """One row per row of ``docs``: ``order``'s column, ``leaf``, ``subroot``, ``root``, ``proof``, ``folded_root``, ``verified``.

    Leaves stand in the order of ``order`` (NULL first, equal ones by their digests) in the tree of their ``group``; the groups' tops, by
    group (NULL first, then by bytes), are the leaves of the tree to the root. A lone node is its own top. ``claimed`` is the
    digest that is tested against the proof, the leaf by default: ``folded_root`` is where it leads, ``verified`` whether that is the
    root. NULLs in any field are told from empty texts; equal rows have equal leaves and each a place of its own. An empty
    table has no rows. Columns that are not in ``fields`` change nothing.
    """
    if arity < 2:
        raise ValueError("a tree needs runs of two or more")
    digest = leaf([F.col(f) for f in fields])
    g = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # sorts as the contract asks, and NULL is a key
    rows = docs.select(g.alias("g"), F.col(order).alias("id"), digest.alias("digest"), (digest if claimed is None else claimed).alias("claimed"))
    numbered = ranked(rows, ["g"], ["id", "digest"], "at")
    levels = grow(numbered.select("g", (F.col("at") - 1).alias("at"), "digest", F.struct("id", "claimed").alias("carried")), arity)
    subroots = ranked(tops(levels).select(F.col("g").alias("name"), "digest"), [], ["name"], "at")
    whole = grow(subroots.select(F.lit("").alias("g"), (F.col("at") - 1).alias("at"), "digest", F.struct("name", "digest").alias("carried")), arity)
    ends = tops(whole).select("g", F.array().cast(STEP).alias("path"), F.col("digest").alias("root"))
    groups = with_paths(whole, ends, arity).select(F.col("carried.name").alias("g"), "path", F.col("digest").alias("subroot"), "root")
    done = with_paths(levels, groups, arity)
    out = done.select(
        F.col("carried.id").alias(order), hexed(F.col("digest")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), hexed(F.col("root")).alias("root"),
        proof(F.col("path")).alias("proof"), fold(F.col("carried.claimed"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_leaf(fields: Sequence[str] = FIELDS, text: str = "text", order: str = "doc_id") -> Column:
    """The leaf after somebody wrote the text's A-Z small in every row whose id's crc32 is divisible by three."""
    small = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col(order).cast("string").cast("binary")) % 3 == 0
    return leaf([F.when(hit, small).otherwise(F.col(f)) if f == text else F.col(f) for f in fields])


def digests(docs: DataFrame) -> DataFrame:
    """The manifest with the proof as its digest, tested against the tampered rows."""
    done = manifest(docs, tampered_leaf())
    return done.select("doc_id", "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified")
