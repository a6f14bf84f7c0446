"""Iterative graph operators: strongly connected parts, longest paths, reach, cohesion.

Every round is one plan of joins whose result is kept in the shared folder, so lineage stays short and a lost
executor costs a round's tasks, not the run. Rounds end when nothing changes, and every loop has a proven bound.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomgraph.operators.skew import Spread, fits_a_task, numbered, sized_join, without
from fathomgraph.plans.shared import Rounds, kept


def _codes(*columns: pa.ChunkedArray) -> tuple[pa.Array, list[np.ndarray]]:
    """The values in the columns, and each column as places among them."""
    both = pa.chunked_array([c for column in columns for c in column.chunks], columns[0].type).combine_chunks().dictionary_encode()
    codes, out, at = both.indices.to_numpy(), [], 0
    for column in columns:
        out.append(codes[at : at + len(column)])
        at += len(column)
    return both.dictionary, out


def _coded(*columns: pa.ChunkedArray) -> tuple[list[str], list[np.ndarray]]:
    """The names in the columns, and each column as places in that list."""
    names, out = _codes(*columns)
    return names.to_pylist(), out


def _ahead(src: np.ndarray, dst: np.ndarray, size: int) -> tuple[list[int], list[int]]:
    """Targets in the order of their sources, and where each source's begin."""
    order = np.argsort(src, kind="stable")
    return dst[order].tolist(), np.searchsorted(src[order], np.arange(size + 1)).tolist()


def _in_one_task(df: DataFrame, solve, schema: str) -> DataFrame:
    """solve(a table with all rows of df), for a df that fits_a_task."""

    def run(batches):
        held = list(batches)
        if held and sum(b.num_rows for b in held):
            yield from solve(pa.Table.from_batches(held)).to_batches()

    return kept(df.coalesce(1).mapInArrow(run, schema))


def _strong_parts(src: np.ndarray, dst: np.ndarray, size: int) -> list[list[int]]:
    """Strongly connected parts of more than one node by depth-first search with low links, without recursion."""
    to, start = _ahead(src, dst, size)
    index, low, on, stack, count = [0] * size, [0] * size, [False] * size, [], 0
    place, parts = start[:-1].copy(), []
    for root in range(size):
        if index[root]:
            continue
        way = [root]
        while way:
            v = way[-1]
            if not index[v]:
                count += 1
                index[v] = low[v] = count
                stack.append(v)
                on[v] = True
            if place[v] < start[v + 1]:
                w = to[place[v]]
                place[v] += 1
                if not index[w]:
                    way.append(w)
                elif on[w]:
                    low[v] = min(low[v], index[w])
                continue
            way.pop()
            if way:
                low[way[-1]] = min(low[way[-1]], low[v])
            if low[v] == index[v]:
                part = []
                while True:
                    w = stack.pop()
                    on[w] = False
                    part.append(w)
                    if w == v:
                        break
                if len(part) > 1:
                    parts.append(part)
    return parts


def _strong_table(links: pa.Table) -> pa.Table:
    names, (src, dst) = _coded(links["src"], links["dst"])
    node, component, sizes = [], [], []
    for part in _strong_parts(src, dst, len(names)):
        own = [names[v] for v in part]
        node += own
        component += [min(own)] * len(own)
        sizes += [len(own)] * len(own)
    return pa.table({"node": pa.array(node, pa.string()), "component": pa.array(component, pa.string()), "size": pa.array(sizes, pa.int64())})


def _depth_table(links: pa.Table) -> pa.Table:
    """Longest paths by taking up nodes once all of their predecessors are done. links has no cycle."""
    names, (src, dst) = _coded(links["src"], links["dst"])
    to, start = _ahead(src, dst, len(names))
    waiting = np.bincount(dst, minlength=len(names)).tolist()
    depth, todo = [0] * len(names), [v for v, n in enumerate(waiting) if not n]
    while todo:
        v = todo.pop()
        for w in to[start[v] : start[v + 1]]:
            depth[w] = max(depth[w], depth[v] + 1)
            waiting[w] -= 1
            if not waiting[w]:
                todo.append(w)
    return pa.table({"node": pa.array(names, pa.string()), "depth": pa.array(depth, pa.int32())})


def _strong_hash_table(links: pa.Table) -> pa.Table:
    """(hash, part) of links between hashes. Links that no cycle can use are shed, with whole arrays, as long as that is worth a pass."""
    names, (src, dst) = _codes(links["src"], links["dst"])
    size, shed = len(names), True
    while shed and len(src):
        ends, begins = np.zeros(size, bool), np.zeros(size, bool)
        ends[dst], begins[src] = True, True
        on = ends[src] & begins[dst]
        shed = np.count_nonzero(~on) * 100 > len(on)
        src, dst = src[on], dst[on]
    used = np.unique(np.concatenate([src, dst]))
    parts = _strong_parts(np.searchsorted(used, src), np.searchsorted(used, dst), len(used))
    node = used[np.array([v for part in parts for v in part], np.int64)]
    return pa.table({"hash": names.take(pa.array(node)), "part": pa.array(np.repeat(np.arange(len(parts)), np.array([len(part) for part in parts], np.int64)), pa.int64())})


def _depth_hash_table(links: pa.Table) -> pa.Table:
    """(hash, depth) of the ends of links between hashes, without cycles."""
    names, (src, dst) = _codes(links["src"], links["dst"])
    levels = _level_table(pa.table({"from": src, "to": dst}))
    return pa.table({"hash": names.take(levels["to"].combine_chunks()), "depth": levels["level"]})


def _label_table(links: pa.Table) -> pa.Table:
    """The least node of each node's group of links, whose direction does not matter."""
    names, (src, dst) = _coded(links["src"], links["dst"])
    up = list(range(len(names)))

    def top(v: int) -> int:
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    for a, b in zip(src.tolist(), dst.tolist()):
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b, key=names.__getitem__)] = min(a, b, key=names.__getitem__)
    return pa.table({"node": pa.array(names, pa.string()), "label": pa.array([names[top(v)] for v in range(len(names))], pa.string())})


NUMBERED_TASK_ROWS = 5_000_000


def _hashed(links: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """links(src, dst) as 64-bit hashes of its ends, and (node, hash); None if they are too many for one task, or should two ends share a hash.

    Each end is hashed where it stands, so links meet no table of numbers. links is read three times: pass it kept or stored.
    """
    if links.count() > NUMBERED_TASK_ROWS:
        return None
    ends = kept(links.select(F.col("src").alias("node")).unionByName(links.select(F.col("dst").alias("node"))).distinct().withColumn("hash", F.xxhash64("node")))
    if ends.count() != ends.select("hash").distinct().count():
        return None
    return kept(links.select(F.xxhash64("src").alias("src"), F.xxhash64("dst").alias("dst"))), ends


def _strong_by_hash(numbers: DataFrame, ends: DataFrame) -> DataFrame:
    found = kept(_in_one_task(numbers, _strong_hash_table, "hash bigint, part bigint").join(ends, "hash").select("node", "part"))
    named = found.groupBy("part").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("size"))
    return kept(found.join(named, "part").select("node", "component", "size"))


def trimmed(links: DataFrame, rounds: int = 4) -> DataFrame:
    """links(src, dst) without those that no cycle can use, as far as `rounds` of shedding ends without a way in or on gets."""
    for _ in range(rounds):
        links = links.join(links.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        links = kept(links.join(links.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
        if links.isEmpty():
            break
    return links


def _least_label(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label): the least node that reaches each node along links, itself included.

    Labels travel along links, and each round also jumps to the label's own label, so rounds grow with the logarithm of distances.
    """
    state, rounds, links = kept(nodes.select("node", F.col("node").alias("label"))), Rounds(), Spread(links.select("src", "dst"), "src")
    while True:
        sent = links.join(state.select(F.col("node").alias("src"), "label")).select(F.col("dst").alias("node"), "label")
        jumped = sized_join(state, state.select(F.col("node").alias("label"), F.col("label").alias("next")), "label").select("node", F.col("next").alias("label"))
        new = state.unionByName(sent).unionByName(jumped).groupBy("node").agg(F.min("label").alias("label"))
        both = rounds.kept(new.join(state.withColumnRenamed("label", "old"), "node"))
        state = both.select("node", "label")
        if both.filter("label != old").isEmpty():
            return kept(state)


def _followed(steps: DataFrame) -> DataFrame:
    """(node, end, low, ring): where each node of steps(node, ptr) ends outside of steps, and the least node on the way.

    Steps double, so rounds are the logarithm of the longest chain. Chains that bite their own tail are rings: they have no end, and low is
    the ring's least node.
    """
    state = kept(steps.select("node", "ptr", F.col("node").alias("low"), F.lit(True).alias("open")))
    n = state.count()
    for _ in range(math.ceil(math.log2(n + 1)) + 1 if n else 0):
        via = state.select(F.col("node").alias("ptr"), F.col("ptr").alias("next"), F.col("low").alias("low2"))
        met = state.join(via, "ptr", "left")
        state = kept(met.select("node", F.coalesce("next", "ptr").alias("ptr"), F.least("low", F.coalesce("low2", "low")).alias("low"), F.col("next").isNotNull().alias("open")))
        if state.filter("open").isEmpty():
            break
    return state.select("node", F.col("ptr").alias("end"), "low", F.col("open").alias("ring"))


def strong_components(links: DataFrame) -> DataFrame:
    """(node, component, size) of the strongly connected parts of links(src, dst) with more than one node; component is the part's least node.

    Links that one task may hold, as they are or as hashes, are solved there. Of more, links that no cycle can use are shed. Nodes with one way in and one way on are drawn into a link between the ends of their chain, which
    leaves a small graph even where cycles are long. Its nodes are coloured with the least node that reaches them; a colour's
    root and the nodes that reach it backwards within the colour form a part. Parts found are taken out and the rest starts over.
    Self-links are ignored. links is read several times: pass it kept or stored.
    """
    links = links.filter("src is not null and dst is not null and src != dst").select("src", "dst")
    if fits_a_task(links):
        return _in_one_task(links, _strong_table, "node string, component string, size bigint")
    if numbers := _hashed(links):
        return _strong_by_hash(*numbers)
    core = trimmed(kept(links.distinct()))
    if fits_a_task(core):
        return _in_one_task(core, _strong_table, "node string, component string, size bigint")
    if numbers := _hashed(core):
        return _strong_by_hash(*numbers)
    ins = core.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n_in"), F.min("src").alias("prev"))
    outs = core.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n_out"), F.min("dst").alias("next"))
    inner = kept(ins.join(outs, "node").filter("n_in = 1 and n_out = 1").select("node", "prev", "next"))
    on = _followed(inner.select("node", F.col("next").alias("ptr")))
    back = _followed(inner.select("node", F.col("prev").alias("ptr")))
    rings = on.filter("ring").select("node", F.col("low").alias("part"))
    chains = kept(on.filter("not ring").select("node", F.col("end").alias("tail")).join(back.select("node", F.col("end").alias("head")), "node"))
    direct = core.join(inner.select(F.col("node").alias("src")), "src", "left_anti").join(inner.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
    small = direct.unionByName(chains.select(F.col("head").alias("src"), F.col("tail").alias("dst"))).distinct()
    parts = kept(_parts(small.filter("src != dst")))
    a, b = parts.select(F.col("node").alias("head"), F.col("part").alias("a")), parts.select(F.col("node").alias("tail"), F.col("part").alias("b"))
    drawn = kept(chains.join(a, "head", "left").join(b, "tail", "left").filter("head = tail or a = b").select("node", "head", F.coalesce("a", "head").alias("part")))
    own = drawn.select(F.col("head").alias("node"), "part")
    every = parts.unionByName(drawn.select("node", "part")).unionByName(own).unionByName(rings).distinct()
    named = every.groupBy("part").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    return kept(every.join(named, "part").select("node", "component", "size"))


def _parts(links: DataFrame) -> DataFrame:
    """(node, part) of the nodes of links(src, dst) that the passes reach; a part of one node may be among them."""
    left, found = kept(links), None
    while True:
        left = trimmed(left)
        if left.isEmpty():
            break
        nodes = left.select(F.col("src").alias("node")).unionByName(left.select(F.col("dst").alias("node"))).distinct()
        colour = _least_label(nodes, left)
        a, b = colour.select(F.col("node").alias("src"), F.col("label").alias("src_colour")), colour.select(F.col("node").alias("dst"), F.col("label").alias("dst_colour"))
        inside = kept(left.join(a, "src").join(b, "dst").filter("src_colour = dst_colour").select("src", "dst", F.col("src_colour").alias("colour")))
        frontier = kept(colour.filter("node = label").select("node", F.col("label").alias("part")))  # backwards from the roots
        part = frontier
        while not frontier.isEmpty():
            back = frontier.join(inside.select(F.col("dst").alias("node"), F.col("src").alias("next"), "colour"), "node").filter("colour = part")
            frontier = kept(back.select(F.col("next").alias("node"), "part").distinct().join(part.select("node"), "node", "left_anti"))
            part = kept(part.unionByName(frontier))
        found = part if found is None else kept(found.unionByName(part))
        left = kept(left.join(part.select(F.col("node").alias("src")), "src", "left_anti").join(part.select(F.col("node").alias("dst")), "dst", "left_anti"))
    return links.select(F.col("src").alias("node"), F.col("dst").alias("part")).limit(0) if found is None else found


def longest_depth(links: DataFrame, cyclic: DataFrame) -> DataFrame:
    """(node, depth): edges on the longest path from a node without predecessors, over links(src, dst) without those with both ends in cyclic(node).

    The rest has no cycle. It is solved in one task that holds it as it is, or as hashes; of more links, each round relaxes the nodes that
    changed, and rounds are as many as the longest path is long.
    """
    inside = kept(cyclic.select("node").distinct())
    a, b = inside.select(F.col("node").alias("src"), F.lit(True).alias("a")), inside.select(F.col("node").alias("dst"), F.lit(True).alias("b"))
    own = links.filter("src != dst").select("src", "dst")
    dag = kept(sized_join(sized_join(own, a, "src", "left"), b, "dst", "left", own).filter("a is null or b is null").select("src", "dst"))
    if fits_a_task(dag):
        return _in_one_task(dag, _depth_table, "node string, depth int")
    if numbers := _hashed(dag):
        return kept(numbers[1].join(_in_one_task(numbers[0], _depth_hash_table, "hash bigint, depth int"), "hash", "left").select("node", F.coalesce("depth", F.lit(0)).alias("depth")))
    nodes = dag.select(F.col("src").alias("node")).unionByName(dag.select(F.col("dst").alias("node"))).distinct()
    depth, rounds, dag = kept(nodes.select("node", F.lit(0).alias("depth"))), Rounds(), Spread(dag, "src")
    moved = depth
    while not moved.isEmpty():
        offer = dag.join(moved.select(F.col("node").alias("src"), "depth")).groupBy(F.col("dst").alias("node")).agg((F.max("depth") + 1).alias("offer"))
        new = rounds.kept(depth.join(offer, "node", "left").select("node", "depth", F.greatest("depth", "offer").alias("new")))
        moved = new.filter("new > depth").select("node", F.col("new").alias("depth"))
        depth = new.select("node", F.col("new").alias("depth"))
    return kept(depth)


def layer_violations(edges: DataFrame, depth: DataFrame, cyclic: DataFrame, fans: DataFrame, functions: DataFrame, threshold: DataFrame, min_gap: int = 2) -> DataFrame:
    """(from_id, to_id, from_depth, to_depth, gap): edges that skip layers, away from cycles and from callees of many.

    edges are clean, call-like ones; threshold is one row, above whose fan-in a callee that is a function is left out.
    """
    pairs = kept(without(edges.select("from_id", "to_id").distinct(), cyclic.select(F.col("node").alias("id")), ["from_id", "to_id"]))
    many = fans.join(F.broadcast(threshold)).filter("fan_in > threshold").join(functions.select("id"), "id", "left_semi").select("id")  # one row
    a = depth.select(F.col("node").alias("from_id"), F.col("depth").alias("from_depth"))
    b = kept(depth.withColumnRenamed("node", "id").join(many, "id", "left_anti").select(F.col("id").alias("to_id"), F.col("depth").alias("to_depth")))
    met = sized_join(sized_join(pairs, b, "to_id"), a, "from_id", keys=pairs)
    return met.withColumn("gap", F.col("to_depth") - F.col("from_depth")).filter(F.col("gap") >= min_gap).select("from_id", "to_id", "from_depth", "to_depth", "gap")


BLOCK_BITS = 512


def blast_radius(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, blast): how many other nodes reach each row of seeds(id) along links(src, dst), at any distance.

    Strongly connected parts shrink to one node, whose size stands for all of its members; what is left has no cycle. Its nodes are numbered and taken in blocks of
    BLOCK_BITS: each node holds one bit for each node of the block that reaches it, and the bits move level by level along all links, so a
    block costs one pass over the links, and pairs are counted and never written. Blocks are dealt to the cores; each core reads the shrunk links as numbers.
    """
    parts = strong_components(links)
    part = kept(parts.select("node", "component"))
    weight = kept(parts.select(F.col("component").alias("rep"), F.col("size").alias("weight")).distinct())
    a, b = part.select(F.col("node").alias("src"), F.col("component").alias("src_part")), part.select(F.col("node").alias("dst"), F.col("component").alias("dst_part"))
    joined = sized_join(sized_join(links.select("src", "dst").distinct(), a, "src", "left"), b, "dst", "left")
    short = kept(joined.select(F.coalesce("src_part", "src").alias("src"), F.coalesce("dst_part", "dst").alias("dst")).filter("src != dst").distinct())
    own = kept(seeds.select("id").distinct().join(part.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("rep")).join(weight, "rep", "left").na.fill(1, ["weight"]))
    reps = short.select(F.col("src").alias("rep")).unionByName(short.select(F.col("dst").alias("rep"))).distinct().join(weight, "rep", "left").na.fill(1, ["weight"])
    nodes = kept(numbered(reps, [F.col("weight"), F.col("rep")], "number").withColumn("code", (F.col("number") - 1).cast("int")).drop("number"))
    coded = kept(sized_join(sized_join(short, nodes.select(F.col("rep").alias("src"), F.col("code").alias("from")), "src"), nodes.select(F.col("rep").alias("dst"), F.col("code").alias("to")), "dst").select("from", "to"))
    coded = sized_join(coded, _levels(coded), "to").select("from", "to", "level")
    cores = links.sparkSession.sparkContext.defaultParallelism
    block = F.floor(F.col("code") / BLOCK_BITS)  # one weight a block and core: nodes are numbered by weight
    asked = nodes.select("code", "weight", block.alias("block"), F.pmod(block, F.lit(cores)).cast("int").alias("core"))
    every = kept(coded).withColumn("core", F.explode(F.sequence(F.lit(0), F.lit(cores - 1))))
    counts = asked.groupBy("core").cogroup(every.groupBy("core")).applyInArrow(_reached, "code int, reached bigint").groupBy("code").agg(F.sum("reached").alias("reached"))
    found = nodes.select("rep", "code").join(counts, "code").select("rep", "reached")
    return own.join(found, "rep", "left").select("id", (F.coalesce("reached", "weight") - 1).alias("blast"))


def _levels(coded: DataFrame) -> DataFrame:
    """(to, level): the longest way to each end of links(from, to) without cycles; in one task if they are few enough, at eight bytes a link."""
    if coded.count() <= NUMBERED_TASK_ROWS:
        return _in_one_task(coded, _level_table, "to int, level int")
    named = coded.select(F.col("from").cast("string").alias("src"), F.col("to").cast("string").alias("dst"))
    return longest_depth(named, named.select(F.col("src").alias("node")).limit(0)).select(F.col("node").cast("int").alias("to"), F.col("depth").alias("level"))


def _level_table(links: pa.Table) -> pa.Table:
    """Level by level, the nodes all of whose predecessors are done, with whole arrays."""
    src, dst = links["from"].to_numpy(), links["to"].to_numpy()
    size = int(max(src.max(), dst.max())) + 1
    order = np.argsort(src, kind="stable")
    to, start = dst[order], np.searchsorted(src[order], np.arange(size + 1))
    waiting, level = np.bincount(dst, minlength=size), np.zeros(size, np.int32)
    front, depth = np.flatnonzero(waiting == 0), 0
    while len(front):
        level[front] = depth
        sizes = start[front + 1] - start[front]
        places = np.repeat(start[front] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        met, times = np.unique(to[places], return_counts=True)
        waiting[met] -= times
        front, depth = met[waiting[met] == 0], depth + 1
    ends = np.unique(dst)
    return pa.table({"to": pa.array(ends, pa.int32()), "level": pa.array(level[ends], pa.int32())})


def _reached(asked: pa.Table, links: pa.Table) -> pa.Table:
    """(code, reached): for each node the weights of the nodes of asked(code, weight, block) from which links(from, to, level) lead to it, itself included.

    Every link ends at a higher level than it starts from. Nodes of one block but different weights are counted apart.
    """
    src, dst, level = (links[c].to_numpy() for c in ("from", "to", "level"))
    codes, weights, blocks = (asked[c].to_numpy() for c in ("code", "weight", "block"))
    size = int(max([*(x.max() for x in (src, dst, codes) if len(x)), -1])) + 1
    order = np.lexsort((dst, level))
    src, dst, level = src[order].astype(np.int32), dst[order].astype(np.int32), level[order]
    steps = []
    for begin, end in zip(*(np.append(np.flatnonzero(np.diff(level, prepend=-1)), len(level))[k:][: len(np.unique(level))] for k in (0, 1))):
        starts = np.flatnonzero(np.diff(dst[begin:end], prepend=-1))
        steps.append((src[begin:end], dst[begin:end][starts], starts))
    total = np.zeros(size, np.int64)
    key = np.lexsort((codes, weights, blocks))
    codes, weights, blocks = codes[key], weights[key], blocks[key]
    edges = np.flatnonzero((np.diff(blocks, prepend=-1) != 0) | (np.diff(weights, prepend=-1) != 0)).tolist()
    for begin, end in zip(edges, [*edges[1:], len(codes)]):
        bits = np.zeros((size, BLOCK_BITS // 64), np.uint64)
        place = np.arange(end - begin)
        bits[codes[begin:end], place >> 6] = np.uint64(1) << (place & 63).astype(np.uint64)
        for sources, targets, starts in steps:
            bits[targets] |= np.bitwise_or.reduceat(bits[sources], starts, axis=0)
        total += int(weights[begin]) * np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    hit = np.flatnonzero(total)
    return pa.table({"code": pa.array(hit, pa.int32()), "reached": pa.array(total[hit], pa.int64())})


def cohesion(edges: DataFrame, functions: DataFrame, modules: DataFrame, min_functions: int = 3) -> DataFrame:
    """(module, functions, components, cohesion): connected groups of a module's functions, and 1 over their number.

    Functions of a module are connected by a structural edge between them, a common target or a common source. A common target or
    source is a node of its own in a bipartite graph per module, so a target of thousands of functions costs as many rows, not their pairs.
    """
    own = modules.join(functions.select("id"), "id", "left_semi")
    big = own.groupBy("module").agg(F.count(F.lit(1)).alias("functions")).filter(F.col("functions") >= min_functions)
    own = kept(own.join(big.select("module"), "module", "left_semi"))
    member, other = F.col("id"), F.col("other")
    out = edges.filter("kind != 'Contains'").select(F.col("from_id").alias("id"), F.concat(F.lit(">"), "to_id").alias("other"))
    into = edges.filter("kind != 'Contains'").select(F.col("to_id").alias("id"), F.concat(F.lit("<"), "from_id").alias("other"))
    shared = sized_join(out.unionByName(into), own, "id").select("module", member.alias("id"), other.alias("other"))
    direct = edges.filter("kind != 'Contains'").select(F.col("from_id").alias("id"), F.col("to_id").alias("to"))
    inner = sized_join(sized_join(direct, own, "id"), own.select(F.col("id").alias("to"), F.col("module").alias("to_module")), "to").filter("module = to_module").select("module", "id", F.concat(F.lit("f"), "to").alias("other"))
    key = lambda c: F.concat_ws("\u0001", F.col("module"), c)
    links = shared.unionByName(inner).select(key(F.concat(F.lit("f"), "id")).alias("src"), key(F.col("other")).alias("dst")).distinct()
    links = kept(links)
    members = own.select("module", key(F.concat(F.lit("f"), "id")).alias("node"))
    if fits_a_task(links):
        labels = _in_one_task(links, _label_table, "node string, label string")
    else:
        both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        labels = _least_label(members.select("node").unionByName(both.select(F.col("src").alias("node"))).distinct(), both)
    groups = members.join(labels, "node", "left").groupBy("module").agg(F.count_distinct(F.coalesce("label", "node")).alias("components"))
    return big.join(groups, "module").select("module", "functions", "components", (1 / F.col("components")).alias("cohesion"))


def test_only_files(imports: DataFrame, tests: DataFrame, production: DataFrame) -> DataFrame:
    """(file): tests, and the files that only tests import, again and again; never those of production(file).

    imports(importer, file); tests(file). Each round adds the files all of whose importers count as tests by then.
    """
    marked = kept(tests.select("file").distinct())
    links = kept(imports.filter("importer != file").select("importer", "file").distinct().join(production, "file", "left_anti"))
    while True:
        by = links.join(marked.select(F.col("file").alias("importer"), F.lit(1).alias("t")), "importer", "left")
        new = kept(by.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.count("t").alias("t")).filter("n = t").select("file").join(marked, "file", "left_anti"))
        if new.isEmpty():
            return marked
        marked = kept(marked.unionByName(new))
