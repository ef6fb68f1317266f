"""Merkle manifest of a dataset (operator 11).

Method: lag and lead windows. A row is a leaf; the leaves of a source are numbered by id.
In each window, lag and lead columns at the fixed offsets of a level, masked by a node's
slot in its run of ``FAN`` and by the run's length, give the digests of its siblings, and
the row of a run's first child hashes the run to their parent. Levels above follow on the
rows of first children, at offsets ``FAN`` times as wide.

A window is a block of ``FAN ** levels`` leaves of one source, so a source with a third of
all rows is dealt over as many tasks as it has blocks. A block's digest is the one row that
goes to the next pass; passes repeat until every source has one node, and then over the
sources' nodes in the same way. Numbers come from a sort by ranges and the counts of each
range, without a window over a whole source. Siblings above a block come back to its leaves
as one list for each block.

Tampering is simulated: where 5 divides the unsigned crc32 of the decimal id, the text's
capitals A to Z are lower-cased. The leaf of that text, or else the original one, is
folded with the original siblings up to a root, which is held against the true one.

Cases: nulls in any column have their own mark and stay null under tampering; a null id is
never tampered with and stands first; a null source is a source of its own and stands
first; rows with one id are ordered by digest, so repeated rows are leaves of their own; a
source with one row has that leaf as its node; a long text is hashed where it is read; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small, saved

FAN = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column | str) -> Column:
    return F.sha2(F.concat(*parts), 256)


def marked(value: Column) -> Column:
    """``-`` for null, else the number of bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, grp, h, changed): the leaf of each row, and that of its tampered text where it is tampered with."""
    fields = [F.col(c) for c in FIELDS]
    lowered = F.translate(F.col("text"), UPPER, LOWER)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("grp"),
        digest(*map(marked, fields)).alias("h"),
        F.when(tampered, digest(*map(marked, [*fields[:-1], lowered]))).alias("changed"),
    )


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``i``, their number in ``grp`` from 0 by ``order``, and ``n``, the rows of ``grp``.

    Rows are sorted by ranges and written with their place; only one row for each range and
    group is summed up, so no task sees a whole group.
    """
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()), "merkle-rows")
    keys = ["grp", *order, "row"]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("row")
    placed = saved(placed.withColumn("place", F.monotonically_increasing_id()), "merkle-places")
    placed = placed.withColumn("part", F.shiftright("place", 33))
    parts = placed.groupBy("grp", "part").agg(F.count("*").alias("here"), F.min("place").alias("first"))
    group = Window.partitionBy("grp")
    before = F.sum("here").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("grp", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("here").over(group).alias("n"))
    return join_small(placed, parts, ["grp", "part"], most=500_000).withColumn("i", F.col("place") + F.col("shift")).drop("place", "part", "shift")


def with_siblings(nodes: DataFrame, levels: int) -> DataFrame:
    """``nodes(grp, i, n, h)`` with ``block``, the block's digest ``up`` on its first row, and ``levels``.

    ``levels`` is array<struct<l, r>>: from the node's own level upwards the digests left and
    right of it and of the nodes above it in its block, for those levels that the group has.
    """
    w = "over (partition by grp, block order by i)"
    rows, h, made = nodes.withColumn("block", F.expr(f"i div {FAN**levels}")), "h", []
    for k in range(levels):
        step = FAN**k
        # Of the node above each row at this level: its slot in its run, how many nodes the run has, and whether the level exists.
        slot, of = f"(i div {step}) % {FAN}", f"(n + {step - 1}) div {step}"
        rows = rows.withColumns({"slot": F.expr(slot), "run": F.expr(f"least({FAN}, {of} - (i div {step} - {slot}))"), "node": F.expr(f"i % {step} = 0 and {of} > 1")})
        left = ", ".join(f"if(slot >= {j}, lag({h}, {j * step}) {w}, '')" for j in range(FAN - 1, 0, -1))
        right = ", ".join(f"if(slot + {j} < run, lead({h}, {j * step}) {w}, '')" for j in range(1, FAN))
        rows = rows.withColumns({f"l{k}": F.expr(f"if(node, concat({left}), null)"), f"r{k}": F.expr(f"if(node, concat({right}), null)")})
        # The first child hashes its run; where the level does not exist the only node goes up as it is.
        rows = rows.withColumn(f"h{k + 1}", F.expr(f"if(i % {step * FAN} = 0, if(node, sha2(concat({h}, r{k}), 256), {h}), null)"))
        h = f"h{k + 1}"
        made += [f"l{k}", f"r{k}", h]
    # The siblings of a first child hold for all rows below its parent's children: the last ones set before them.
    below = lambda side, k: f"last({side}{k}, true) {w}" if k else f"{side}0"
    each = ", ".join(f"struct({below('l', k)} as l, {below('r', k)} as r)" for k in range(levels))
    return rows.withColumns({"levels": F.expr(f"filter(array({each}), x -> x.l is not null)"), "up": F.expr(h)}).drop("slot", "run", "node", *made)


def climbed(nodes: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The passes from ``nodes`` upwards, each with its siblings, and (grp, h): the one node of every group."""
    passes = []
    while True:
        passes.append(with_siblings(nodes, levels))
        size = FAN**levels
        up = passes[-1].where("up is not null")
        nodes = saved(up.select("grp", F.col("block").alias("i"), F.expr(f"(n + {size - 1}) div {size}").alias("n"), F.col("up").alias("h")), "merkle-nodes")
        if not (nodes.agg(F.max("n")).first()[0] or 0) > 1:
            return passes, nodes.select("grp", "h")


def below(rows: DataFrame, above: DataFrame) -> DataFrame:
    """``rows`` of a pass with ``path``: their own levels and those of ``above(grp, i, path, …)``, their block's."""
    above = above.withColumnsRenamed({"i": "block", "path": "further"})
    return rows.join(above, ["grp", "block"]).withColumn("path", F.concat("levels", "further")).drop("further", "levels", "block", "up")


def descended(passes: list[DataFrame], top: DataFrame) -> DataFrame:
    """The first pass with ``path``: all levels from there to the root; ``top(grp, path, …)`` is above the last pass."""
    above = top.withColumn("i", F.lit(0).cast("long"))
    for rows in reversed(passes[1:]):
        above = saved(below(rows, above).drop("h", "n"), "merkle-paths")
    return below(passes[0], above)


def folded(leaf: Column, path: Column) -> Column:
    """The root over ``leaf`` and its siblings."""
    return F.aggregate(path, leaf, lambda h, x: digest(x.l, h, x.r))


def manifest(docs: DataFrame, *, levels: int = 2) -> DataFrame:
    """One row per document: leaf, the node of its source, root, digest of its proof, and the check of the tampered leaf."""
    rows = numbered(leaves(docs), "doc_id", "h")
    passes, subroots = climbed(rows, levels)
    sources = numbered(subroots.select(F.lit("all").alias("grp"), F.col("grp").alias("source"), "h"), "source")
    upper, top = climbed(sources, levels)
    root = top.first()
    root = F.lit(root.h if root else None).cast("string")
    no_level = F.array().cast("array<struct<l:string,r:string>>")
    sources = descended(upper, top.select("grp", no_level.alias("path")))
    sources = saved(sources.select(F.col("source").alias("grp"), F.col("h").alias("subroot"), "path"), "merkle-sources")
    out = descended(passes, sources)
    proof = F.aggregate("path", F.lit(""), lambda s, x: F.concat(s, x.l, x.r))
    out = out.withColumn("folded_root", folded(F.coalesce("changed", "h"), F.col("path")))
    return out.select(
        "doc_id",
        F.col("h").alias("leaf"),
        "subroot",
        root.alias("root"),
        F.sha2(proof, 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == root).alias("verified"),
    )


def oracle(depth: int = 6, source_depth: int = 5) -> str:
    """The same rows in DuckDB: runs are strings of digests, for up to 16 ** depth rows a source."""
    mark = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"
    leaf = lambda text: f"sha256({' || '.join(mark(c) for c in (*FIELDS[:-1], text))})"
    crc = """xor(4294967295, list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint),
        lambda x, b: list_reduce(range(8), lambda y, k: xor(y >> 1, (y & 1) * 3988292384), xor(x, b)), 4294967295::bigint))"""

    def levels(prefix: str, depth: int) -> str:
        """From {prefix}n0(g, i, h) the nodes of every level, and from {prefix}s0(…, g, i, f, proof) the folded rows."""
        out = ""
        for k in range(depth):
            out += f""",
    {prefix}c{k} as (select g, count(*) > 1 as many from {prefix}n{k} group by g),
    {prefix}g{k} as (select g, i // 16 as p, string_agg(h, '' order by i) as run, many from {prefix}n{k} join {prefix}c{k} using (g) group by all),
    {prefix}n{k + 1} as (select g, p as i, case when many then sha256(run) else run end as h from {prefix}g{k}),
    {prefix}t{k} as (select s.*, many, substr(run, 1, 64 * (i % 16)) as l, substr(run, 64 * (i % 16) + 65) as r from {prefix}s{k} s join {prefix}g{k} x on s.g = x.g and s.i // 16 = x.p),
    {prefix}s{k + 1} as (select * exclude (many, l, r) replace (i // 16 as i, case when many then sha256(l || f || r) else f end as f, case when many then proof || l || r else proof end as proof) from {prefix}t{k})"""
        return out

    return f"""
    with d as (select doc_id, coalesce('=' || source, '') as g, {leaf('text')} as leaf,
        case when {crc} % 5 = 0 then {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} end as changed from documents),
    an0 as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as i, leaf as h from d),
    as0 as (select doc_id, leaf, g, i, coalesce(changed, leaf) as f, '' as proof from an0){levels('a', depth)},
    bn0 as (select 'all' as g, row_number() over (order by g) - 1 as i, h, g as source from an{depth}),
    bs0 as (select a.doc_id, a.leaf, b.h as subroot, 'all' as g, b.i, a.f, a.proof from as{depth} a join bn0 b on a.g = b.source){levels('b', source_depth)},
    top as (select h as root from bn{source_depth})
    select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, f as folded_root, f = root as verified from bs{source_depth}, top"""
