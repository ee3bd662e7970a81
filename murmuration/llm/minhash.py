"""Near copies by an LSH forest: several sorted orders of MinHash signatures, neighbours with long common prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.llm.common import mix, prefix_hash, span_hash, text_slices, tidy
from murmuration.llm.features import word_bounds
from murmuration.session import cut_lineage

TREES, DEPTH = 24, 6  # orders, and hashes in each order's keys
BASE_DEPTH = 3  # two documents that share so many first hashes in an order are compared: a pair at 0.75 is missed by all with chance 2e-6
CHAIN_TREES = 8  # orders whose neighbours are linked first, so that groups of copies are one before anything else is compared
HASHES = TREES * DEPTH
LABEL = 2 * DEPTH  # bytes of an order's key
ESTIMATE = 0.5  # pairs below this share of equal hashes are not looked at: 0.75 falls there with chance 1e-9
PIECE_ROWS = 1024
FEW = 2048  # odd rows of a region that meet a piece in one task
WANTED_BROADCAST = 1 << 20  # ids, 8 bytes each
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_RANDOM = mix(np.arange(1, 1 + 2 * HASHES + 64, dtype=np.uint64))
FACTORS = (_RANDOM[:HASHES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
OFFSETS = (_RANDOM[HASHES : 2 * HASHES] >> np.uint64(32)).astype(np.uint32)
PLACES = _RANDOM[2 * HASHES :] | np.uint64(1)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles of ``k`` words as rising 64-bit hashes, and the bounds of its set.

    Words are what stands between ASCII white space, A-Z in lower case. A text of fewer words has one shingle
    of them all, a text without words none.
    """
    data = LOWER[data]
    starts, stops, of_text = word_bounds(data, bounds)
    word = span_hash(prefix_hash(data), starts, stops) if len(starts) else np.empty(0, np.uint64)
    words = np.diff(of_text)
    sizes = np.where(words >= k, words - k + 1, (words > 0).astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(ends[-1]) + np.repeat(of_text[:-1] - ends[:-1], sizes)  # first word of each shingle
    held = np.repeat(np.minimum(words, k), sizes)
    value = held.astype(np.uint64) * PLACES[k]
    for j in range(k):
        inside = j < held
        value[inside] += word[at[inside] + j] * PLACES[j]
    value = mix(value)
    for first, last in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        value[first:last].sort()
    distinct = np.ones(len(value), bool)
    distinct[1:] = value[1:] != value[:-1]
    distinct[ends[:-1][sizes > 0]] = True
    counted = np.concatenate([[0], np.cumsum(distinct)])
    return value[distinct], counted[ends]


def set_names(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set that does not depend on the order of its members; zero for the empty set."""
    out = np.zeros(len(bounds) - 1, np.uint64)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        out[full] = mix(np.add.reduceat(mix(values ^ PLACES[-1]), bounds[full]))
    return out.view(np.int64)


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """16 bits of each of the least hashes of non-empty sets, big-endian."""
    full = bounds[:-1][np.diff(bounds) > 0]
    x = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(full), HASHES), ">u2")
    for j in range(HASHES):
        least = np.minimum.reduceat(x * FACTORS[j] + OFFSETS[j], full)
        out[:, j] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """``(id, n, node, sig)`` of ``(id, text)``: set size, name of the set, signature (null if it is empty)."""

    def run(batches):
        for batch in batches:
            for first, last, data, bounds in text_slices(batch.column(1)):
                values, ends = shingle_sets(data, bounds, k)
                sizes = np.diff(ends)
                signed = iter(signatures(values, ends))
                sig = [next(signed).tobytes() if n else None for n in sizes]
                arrays = [batch.column(0).slice(first, last - first), pa.array(sizes), pa.array(set_names(values, ends)), pa.array(sig, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "n", "node", "sig"])
        tidy()

    return docs.mapInArrow(run, "id long, n long, node long, sig binary")


NEIGHBOURS = "kind int, tree int, label binary, node long, n long, other long"


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many first hashes the keys in two arrays of rows of hashes share."""
    return np.cumprod(a == b, axis=1).sum(axis=1)


def alike_in_size(n: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n, other) >= percent * np.maximum(n, other)


def neighbours(orders: DataFrame, percent: int) -> DataFrame:
    """From ``(tree, label, node, n)`` in order: kind 0, links to try; kind 1, rows with company at the base depth;
    kind 2, the first and last rows of a partition, which may have company beyond it."""

    def rows(batch_rows: list, kind: int) -> list[pa.Array]:
        return [pa.array(np.full(len(batch_rows[0]), kind, np.int32)), *batch_rows]

    def run(batches):
        last = None  # the row before this batch, and whether it was given out
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            joined = pa.concat_tables([last[0], table]) if last else table
            tree, node, n = (joined[c].to_numpy() for c in ("tree", "node", "n"))
            label = np.frombuffer(b"".join(joined["label"].to_pylist()), ">u2").reshape(-1, DEPTH)
            depth = np.where(tree[1:] == tree[:-1], common_prefix(label[1:], label[:-1]), 0)
            near = depth >= BASE_DEPTH
            tried = np.flatnonzero(near & (tree[1:] < CHAIN_TREES) & alike_in_size(n[1:], n[:-1], percent))
            company = np.zeros(len(node), bool)
            company[1:] |= near
            company[:-1] |= near
            edge = np.zeros(len(node), bool)
            if last is None:
                edge[0] = True
            else:
                company[0] &= not last[1]  # given out before
            labels = joined["label"].combine_chunks()
            for kind, at, others in ((0, tried, tried + 1), (1, np.flatnonzero(company), None), (2, np.flatnonzero(edge), None)):
                if len(at):
                    other = pa.array(node[others]) if others is not None else pa.nulls(len(at), pa.int64())
                    held = [pa.array(tree[at].astype(np.int32)), labels.take(pa.array(at)), pa.array(node[at]), pa.array(n[at]), other]
                    yield pa.RecordBatch.from_arrays(rows(held, kind), names=["kind", "tree", "label", "node", "n", "other"])
            given = bool(company[-1]) or (last is not None and len(node) == 1 and last[1])
            last = joined.slice(joined.num_rows - 1), given
        if last:
            held = [last[0][c].combine_chunks() for c in ("tree", "label", "node", "n")]
            yield pa.RecordBatch.from_arrays(rows([held[0].cast(pa.int32()), *held[1:], pa.nulls(1, pa.int64())], 2), names=["kind", "tree", "label", "node", "n", "other"])

    return orders.mapInArrow(run, NEIGHBOURS)


def across_edges(edges: list, percent: int) -> tuple[list, list]:
    """``(links to try, rows with company)`` among the first and last rows of the partitions of an order."""
    edges = sorted({(e["tree"], bytes(e["label"]), e["node"], e["n"]) for e in edges})
    links, company = [], set()
    for a, b in zip(edges, edges[1:], strict=False):
        if a[0] == b[0] and a[1][: 2 * BASE_DEPTH] == b[1][: 2 * BASE_DEPTH]:
            company |= {a, b}
            if a[0] < CHAIN_TREES and 100 * min(a[3], b[3]) >= percent * max(a[3], b[3]):
                links.append((a[2], b[2]))
    return links, sorted(company)


def full_sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """``(node, members)``: the whole sets of some nodes, made again from a text of each."""
    wanted = cut_lineage(classes.join(nodes, "node").select(F.col("rep").alias("id"), "node"), "wanted")
    ids = wanted.select("id").distinct()
    ids = F.broadcast(ids) if wanted.count() <= WANTED_BROADCAST else ids

    def sets(batches):
        for batch in batches:
            for _, _, data, bounds in text_slices(batch.column(1)):
                values, ends = shingle_sets(data, bounds, k)
                held = [values[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(set_names(values, ends)), pa.array(held, pa.binary())], names=["node", "members"])
        tidy()

    members = docs.join(ids, "id", "left_semi").select("id", "text").mapInArrow(sets, "node long, members binary")
    return cut_lineage(members.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs ``(a, b)`` of nodes whose whole sets are similar enough."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    members = full_sets(nodes, classes, docs, k)

    def compare(batches):
        for batch in batches:
            good = []
            a, b = batch.column(0), batch.column(1)
            for row, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(both) - shared):
                    good.append(row)
            taken = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([a.take(taken), b.take(taken)], names=["a", "b"])

    left = pairs.join(members.withColumnsRenamed({"node": "a", "members": "x"}), "a")
    met = left.join(members.withColumnsRenamed({"node": "b", "members": "y"}), "b").select("a", "b", "x", "y")
    return cut_lineage(met.mapInArrow(compare, "a long, b long"), "links")


def with_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``(node, component)`` of all linked nodes."""
    from murmuration.operators.cluster import connected_components  # here, so that workers need not load what it needs

    return cut_lineage(connected_components(links), "components")


def merged_components(named: DataFrame, links: DataFrame) -> DataFrame:
    """Components that further links tie together; each old one stands for all its rows."""
    stars = named.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    return with_components(named, links.unionByName(stars))


def regions(company: DataFrame, named: DataFrame, depth: int = BASE_DEPTH) -> DataFrame:
    """``(region, label, node, n, comp, odd, pieces, blocks)``: the rows of regions in which more than one component meets.

    ``odd`` rows are those outside the region's largest component. A region is one prefix of one order,
    ``depth`` hashes long.
    """
    rows = company.join(named, "node", "left").select("tree", "label", "node", "n", F.coalesce("component", "node").alias("comp"))
    prefix = F.expr(f"substring(label, 1, {2 * depth})")
    keyed = cut_lineage(rows.withColumn("region", F.struct("tree", prefix.alias("prefix"))).drop("tree"), "company")
    parts = keyed.groupBy("region", "comp").agg(F.count(F.lit(1)).alias("rows"))
    sizes = parts.groupBy("region").agg(F.max(F.struct("rows", "comp")).alias("main"), F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("parts"))
    mixed = sizes.where("parts > 1").select(
        "region",
        F.col("main.comp").alias("main"),
        F.ceil(F.col("rows") / PIECE_ROWS).cast("int").alias("pieces"),
        F.ceil((F.col("rows") - F.col("main.rows")) / FEW).cast("int").alias("blocks"),
    )
    met = keyed.join(mixed, "region").withColumn("odd", F.col("comp") != F.col("main"))
    return cut_lineage(met.select("region", "label", "node", "n", "comp", "odd", "pieces", "blocks"), "regions")


def in_pieces(rows: DataFrame) -> DataFrame:
    """A region's rows dealt into pieces and its odd rows into blocks; each block meets each piece."""
    own = rows.withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")).withColumn("odd", F.lit(False))
    own = own.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    every = rows.where("odd").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    every = every.withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    return own.unionByName(every)


def candidates(table: pa.Table, percent: int, depth: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each odd row of a piece with those of other components that look similar by their signatures.

    A pair comes up once in all: at the depth of its longest common prefix in any order, in the first such order.
    """
    odd = table["odd"].to_numpy()
    n, comp, tree = table["n"].to_numpy(), table["comp"].to_numpy(), table["region"][0].as_py()["tree"]
    sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint16).reshape(len(n), TREES, DEPTH)
    members = np.flatnonzero(~odd)
    for row in np.flatnonzero(odd):
        other = members[(comp[members] != comp[row]) & alike_in_size(n[members], n[row], percent)]
        if len(other):
            same = sig[other] == sig[row]
            good = same.mean(axis=(1, 2)) >= ESTIMATE
            good &= same[:, :, :depth].all(axis=2).argmax(axis=1) == tree
            good &= ~same[:, :, : depth + 1].all(axis=2).any(axis=1) if depth < DEPTH else True  # met deeper
            if good.any():
                yield row, other[good]


def across_components(rows: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int, depth: int) -> DataFrame:
    """``(a, b)``: confirmed links between components that meet in a region of a depth, one for each row and component.

    Signatures tell the rows that have anyone to be compared with; only their sets travel. Pairs stay in the task.
    """
    signed = cut_lineage(rows.drop("label").join(classes.select("node", "sig"), "node"), "signed")

    def look(table: pa.Table) -> pa.Table:
        found = np.zeros(table.num_rows, bool)
        for row, others in candidates(table, percent, depth):
            found[row] = True
            found[others] = True
        return table.filter(pa.array(found)).select(["region", "node"])

    region = signed.schema["region"].dataType.simpleString()
    busy = in_pieces(signed).groupBy("region", "block", "piece").applyInArrow(look, f"region {region}, node long").distinct()
    busy = cut_lineage(signed.join(busy, ["region", "node"]), "busy")
    sets = full_sets(busy.select("node").distinct(), classes, docs, k)

    def link(table: pa.Table) -> pa.Table:
        node, comp = table["node"].to_numpy(), table["comp"].to_numpy()
        members = table["members"].to_pylist()
        out = []
        for row, others in candidates(table, percent, depth):
            own = np.frombuffer(members[row], np.uint64)
            sizes = np.array([len(members[x]) // 8 for x in others])
            held = np.frombuffer(b"".join(members[x] for x in others), np.uint64)
            shared = own[np.minimum(np.searchsorted(own, held), len(own) - 1)] == held
            both = np.add.reduceat(shared, np.cumsum(sizes) - sizes, dtype=np.int64)
            linked = others[100 * both >= percent * (sizes + len(own) - both)]
            for x in linked[np.unique(comp[linked], return_index=True)[1]]:
                out.append((node[row], node[x]))
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    whole = in_pieces(busy.join(sets, "node"))
    return cut_lineage(whole.groupBy("region", "block", "piece").applyInArrow(link, "a long, b long").distinct(), "links")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` of every document.

    Two documents are linked if ``100 * shared >= percent * (all shingles of either)``, judged on their whole
    sets of ``k``-word shingles; ``component_id`` is the smallest id that links reach, ``kept`` marks the documents
    that bear it. Null, empty and blank texts have no shingles and no links. Rows without an id take part in no link,
    have no component and are kept. Rows that repeat an id are one document of several texts if these differ.
    Other columns are not read; an empty table gives an empty table.

    Equal sets become one node first, whatever their number. The nodes' signatures are sorted in ``TREES`` orders,
    each cut into ranges, so no prefix fills one task. Neighbours in some orders are confirmed and joined to
    components, which leaves groups of copies in one piece. The depth then adapts to what is left: regions of rows that
    share all ``DEPTH`` hashes of an order are compared first and what they link is joined; then only regions in which
    several components still meet climb to one hash less, down to ``BASE_DEPTH``. In a region the rows outside its largest
    component are compared, block by block with all its pieces: the work grows with these rows times the region's, and
    no pair is compared on whole sets twice. Sets are compared by 64-bit hashes of shingles.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    sketched = cut_lineage(sketch(source, k), "sketch")
    usable = sketched.where("n > 0 AND id IS NOT NULL")
    classes = cut_lineage(usable.groupBy("node").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.min("sig").alias("sig")), "classes")
    orders = classes.select("node", "n", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    orders = orders.select("tree", F.expr(f"substring(sig, tree * {LABEL} + 1, {LABEL})").alias("label"), "node", "n")
    in_order = orders.repartitionByRange("tree", "label", "node").sortWithinPartitions("tree", "label", "node")
    found = cut_lineage(neighbours(in_order, percent), "neighbours")
    edge_links, edge_company = across_edges(found.where("kind = 2").collect(), percent)  # two rows a partition
    tried = found.where("kind = 0").select(F.col("node").alias("a"), F.col("other").alias("b"))
    tried = tried.unionByName(spark.createDataFrame(edge_links, "a long, b long"))
    pairs = cut_lineage(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    links = confirmed(pairs, classes, source, k, percent)
    named = with_components(classes, links)
    columns = ["tree", "label", "node", "n"]
    company = found.where("kind = 1").select(*columns).unionByName(spark.createDataFrame(edge_company, "tree int, label binary, node long, n long"))
    # components only merge, so what is in one piece at the base depth stays so at every depth
    apart = regions(company.distinct(), named).select("region.tree", "label", "node", "n")
    for depth in range(DEPTH, BASE_DEPTH - 1, -1):
        if apart.isEmpty():
            break
        further = across_components(regions(apart, named, depth), classes, source, k, percent, depth)
        if not further.isEmpty():
            named = merged_components(named, further)
    reps = classes.select("node", "rep").join(named, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))
    # repeated ids tie the nodes they name together
    least = reps.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_node = reps.join(least, "component").select("node", "component_id")
    joined = sketched.select("id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(of_node, "node", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return joined.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )
