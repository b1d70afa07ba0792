"""GIN over many small graphs: rows sorted by graph become blocks of whole graphs, and a block's layers are matrix products.

Spark brings a graph's rows together with one shuffle and sorts them; a task goes through them in stretches, so it holds a
stretch and not its partition. A graph of more than LARGE rows is named instead of held, for the callers to send it the
way of joins (layers.gin_by_joins, gradients.gin_gradients_by_joins), so none is left out. What is shuffled after
a pass has the models' size. Models come to every task whole: their numbers, not the graphs', are what is collected.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows (nodes, edges and label) that a task gathers before it makes a block; more rows of one graph than LARGE go by joins.
STRETCH, LARGE = 1 << 17, 1 << 21
LABEL, NODE, EDGE = range(3)
#: A block's arrays: each graph's class; each node's graph (by its place in the block) and features; ends as places of nodes.
PARTS = {"y": np.int64, "g": np.int64, "x": np.float64, "known": np.bool_, "src": np.int64, "dst": np.int64}


def graph_blocks(nodes: DataFrame, edges: DataFrame, graphs: DataFrame | None = None, by: Sequence[str] = (), large: int = LARGE) -> DataFrame:
    """Blocks (*by, graphs, y, g, x, known, src, dst, large) of nodes(*by, graph_id, node_id, x), edges(*by, graph_id, src, dst).

    With graphs(*by, graph_id, y) only these are taken, and edges between nodes of theirs; without, nodes that have
    neighbours with features only are there as well, unknown at first. A graph without nodes is left out. `large` is the
    id of a graph that is in no block.
    """
    keys = [*by, "graph_id"]
    whole = lambda df, *ends: df.where(" AND ".join(f"{c} IS NOT NULL" for c in [*keys, *ends]))
    row = lambda df, kind, a, b, x: df.select(*keys, F.lit(kind).cast("byte").alias("kind"), a.cast("long").alias("a"), b.cast("long").alias("b"), x.alias("x"))
    none, nothing = F.lit(0), F.lit(None).cast("array<double>")
    rows = row(whole(nodes, "node_id"), NODE, F.col("node_id"), none, F.col("x"))
    rows = rows.unionByName(row(whole(edges, "src", "dst"), EDGE, F.col("src"), F.col("dst"), nothing))
    if graphs is not None:
        rows = rows.unionByName(row(whole(graphs), LABEL, F.coalesce("y", F.lit(-1)), none, nothing))
    id_type = rows.schema["graph_id"].dataType
    schema = T.StructType([*rows.select(*by).schema.fields, T.StructField("graphs", T.ArrayType(id_type)), *[T.StructField(p, T.BinaryType()) for p in PARTS], T.StructField("large", id_type)])
    labelled = graphs is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, too_large in _stretches(batches, keys, large):
            if too_large:
                out = {**{k: table[k].slice(0, 1) for k in by}, "graphs": [None], **{p: [None] for p in PARTS}, "large": table["graph_id"].slice(0, 1)}
                yield _batch(out, table, by)
                continue
            starts = [*np.flatnonzero(_begins(table, by)), len(table)] if by else [0, len(table)]
            for start, end in zip(starts, starts[1:]):
                part = table.slice(start, end - start)
                parts = _block(part, _begins(part, keys), labelled)
                if parts is not None:
                    ids, arrays = parts
                    yield _batch({**{k: part[k].slice(0, 1) for k in by}, "graphs": _lists(ids, [0, len(ids)]), **{p: [arrays[p].astype(t).tobytes()] for p, t in PARTS.items()}, "large": [None]}, table, by)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _batch(out: dict, table: pa.Table, by: Sequence[str]) -> pa.RecordBatch:
    """One row of blocks."""
    kind = table.schema.field("graph_id").type
    types = {"graphs": pa.list_(kind), "large": kind, **dict.fromkeys(PARTS, pa.binary())}
    arrays = {k: v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v if isinstance(v, pa.Array) else pa.array(v, types[k]) for k, v in out.items()}
    return pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))


def _lists(values: pa.Array, ends: Sequence[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _begins(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Whether a row's keys differ from those of the row before; the first one's do."""
    new = np.zeros(len(table), bool)
    new[0] = True
    for key in keys:
        values = table[key].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return new


def _stretches(batches: Iterator[pa.RecordBatch], keys: Sequence[str], large: int) -> Iterator[tuple[pa.Table, bool]]:
    """Tables of whole graphs from sorted rows, or (the first rows of a graph of more than `large` rows, True), once each."""
    held, rows, due, dropped = [], 0, STRETCH, None

    def ready(last: bool):
        nonlocal held, rows, due, dropped
        table = pa.Table.from_batches(held).combine_chunks()
        starts = [*np.flatnonzero(_begins(table, keys)), len(table)]
        if dropped is not None:
            if [table[k][0] for k in keys] == dropped:
                table, starts = table.slice(starts[1]), [s - starts[1] for s in starts[1:]]
            if len(table):
                dropped = None
        done = [] if len(table) == 0 else starts if last else starts[:-1]
        start = 0
        for a, b in zip(starts, starts[1:]):
            if b - a > large:  # what is whole before it first, so that order stays
                if a > start:
                    yield table.slice(start, a - start), False
                yield table.slice(a, 1), True
                start = b
                if b == len(table):
                    dropped = [table[k][a] for k in keys]
        end = max(start, done[-1]) if done else start
        if end > start:
            yield table.slice(start, end - start), False
        rest = table.slice(end)
        held, rows = (rest.to_batches() if len(rest) else []), len(rest)
        due = rows + min(STRETCH, large)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= due:
            yield from ready(False)
    if held:
        yield from ready(True)


def _block(table: pa.Table, begins: np.ndarray, labelled: bool) -> tuple[pa.Array, dict[str, np.ndarray]] | None:
    """The ids and arrays of the graphs of sorted rows; None if none has a node."""
    kind, a, b = (table[c].to_numpy() for c in ("kind", "a", "b"))
    graph = np.cumsum(begins) - 1
    taken = np.ones(graph[-1] + 1, bool)
    y = np.full(len(taken), -1)
    if labelled:
        y[graph[kind == LABEL]] = a[kind == LABEL]
        taken[:] = False
        taken[graph[kind == LABEL]] = True
    node, edge = (kind == NODE) & taken[graph], (kind == EDGE) & taken[graph]
    # ends as places of nodes: a key of graph and id, ids numbered within the block
    ids, place = np.unique(np.concatenate([a[node], a[edge], b[edge]]), return_inverse=True)
    n, m = node.sum(), edge.sum()
    key = np.concatenate([graph[node], graph[edge], graph[edge]]) * max(len(ids), 1) + place
    known = key[:n] if labelled else np.concatenate([key[:n], key[n : n + m]])
    every = np.unique(known)
    if not n:
        return None
    at = np.searchsorted(every, key)
    there = every[np.minimum(at, len(every) - 1)] == key
    both = there[n : n + m] & there[n + m :]
    values = table["x"].combine_chunks().filter(pa.array(node))
    flat = values.flatten().to_numpy(zero_copy_only=False)
    x = np.zeros((len(every), len(flat) // n))
    x[at[:n]] = flat.reshape(n, -1)
    mask = np.zeros(len(every), bool)
    mask[at[:n]] = True
    g = every // max(len(ids), 1)
    some, g = np.unique(g, return_inverse=True)
    first = np.flatnonzero(begins)[some]
    return table["graph_id"].take(pa.array(first)).combine_chunks(), {"y": y[some], "g": g, "x": x, "known": mask, "src": at[n : n + m][both], "dst": at[n + m :][both]}


def _models(weights: DataFrame, by: Sequence[str]) -> dict:
    """Each model's layers as matrices and biases."""
    found: dict = {}
    for row in weights.select(*by, "layer", "w", "b").collect():
        found.setdefault(tuple(row[k] for k in by), {})[row["layer"]] = (np.array(row["w"], float), np.array(row["b"], float))
    return found


def _add(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Rows of values added up by place."""
    return np.stack([np.bincount(at, column, n) for column in values.T], 1)


def _arrays(row: dict) -> dict[str, np.ndarray]:
    return {p: np.frombuffer(row[p], t) for p, t in PARTS.items()}


def _passed(block: dict, model: dict, layers: int):
    """(scores, post's outputs, pools, [(input, inner values, output) of each layer], which graphs have known nodes)."""
    put = lambda v, layer: v @ model[layer][0].T + model[layer][1]
    n, src, dst, known = len(block["g"]), block["src"], block["dst"], block["known"]
    x, held = put(block["x"].reshape(n, -1), "pre"), []
    for k in range(layers):
        moved = x @ model[f"conv{k}.0"][0].T
        if known.all():
            summed = moved + _add(src, moved[dst], n)
        else:
            moved[~known] = 0
            summed, known = moved + _add(src, moved[dst], n), known | (np.bincount(src[known[dst]], minlength=n) > 0)
        inner = np.maximum(summed + model[f"conv{k}.0"][1], 0)
        outer = np.maximum(put(inner, f"conv{k}.1"), 0)
        held.append((x, inner, outer))
        x = outer
    pool = _add(block["g"], np.where(known[:, None], x, 0), len(block["y"]))
    post = np.maximum(put(pool, "post"), 0)
    return put(post, "readout"), post, pool, held, np.bincount(block["g"][known], minlength=len(block["y"])) > 0


def _log_softmax(scores: np.ndarray) -> np.ndarray:
    less = scores - scores.max(1, keepdims=True)
    return less - np.log(np.exp(less).sum(1, keepdims=True))


def block_scores(blocks: DataFrame, weights: DataFrame, layers: int, by: Sequence[str] = ()) -> DataFrame:
    """(*by, graph_id, x) log-probabilities of each graph; x is null for those that are too large for a block."""
    models, fields = _models(weights, by), blocks.select(*by).schema.fields
    schema = T.StructType([*fields, T.StructField("graph_id", blocks.schema["large"].dataType), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, kind = [*by, "graph_id", "x"], batch.schema.field("large").type
            ids, rows = batch["graphs"], batch.drop_columns(["graphs"]).to_pylist()
            for place, row in enumerate(rows):
                model = tuple(row[k] for k in by)
                if model not in models:
                    continue
                if row["large"] is not None:
                    graphs, x = pa.array([row["large"]], kind), pa.array([None], pa.list_(pa.float64()))
                else:
                    scores, *_, there = _passed(_arrays(row), models[model], layers)
                    graphs, scores = ids[place].values.filter(pa.array(there)), _log_softmax(scores)[there]
                    x = _lists(pa.array(scores.ravel()), np.arange(len(scores) + 1) * scores.shape[1])
                own = [pa.array([m] * len(graphs), batch.schema.field(k).type) for k, m in zip(by, model)]
                yield pa.RecordBatch.from_arrays([*own, graphs, x], names)

    return blocks.mapInArrow(run, schema)


def block_gradients(blocks: DataFrame, weights: DataFrame, layers: int, by: Sequence[str] = ()) -> DataFrame:
    """(*by, large, name, pos, v): sums over graphs of the gradients of the negative log-likelihood, in long form.

    The name "" has the number of graphs; a row with `large` names a graph that is in no block.
    """
    models, fields = _models(weights, by), blocks.select(*by).schema.fields
    schema = T.StructType([*fields, blocks.schema["large"], T.StructField("name", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("v", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, large, kinds = {}, [], None
        for batch in batches:
            kinds = [*[batch.schema.field(k).type for k in by], batch.schema.field("large").type, pa.string(), pa.int64(), pa.float64()]
            for row in batch.drop_columns(["graphs"]).to_pylist():
                model = tuple(row[k] for k in by)
                if model not in models:
                    continue
                if row["large"] is not None:
                    large.append((*model, row["large"], None, 0, 0.0))
                    continue
                mine = sums.setdefault(model, {})
                for name, v in _gradient(_arrays(row), models[model], layers).items():
                    mine[name] = mine.get(name, 0) + v
        rows = large + [(*model, None, name, pos, float(v)) for model, mine in sums.items() for name, values in mine.items() for pos, v in enumerate(np.ravel(values))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [f.name for f in schema.fields])

    return blocks.mapInArrow(run, schema).groupBy(*by, "large", "name", "pos").agg(F.sum("v").alias("v"))


def _gradient(block: dict, model: dict, layers: int) -> dict[str, np.ndarray]:
    """The errors' way back: through a matrix by its transpose, through a neighbourhood sum by the same sum."""
    scores, post, pool, held, _ = _passed(block, model, layers)
    n, src, dst, y = len(block["g"]), block["src"], block["dst"], block["y"]
    found = {"": np.array([len(y)], float)}

    def dense(layer: str, error: np.ndarray, value: np.ndarray) -> None:
        found[f"{layer}.weight"], found[f"{layer}.bias"] = error.T @ value, error.sum(0)

    error = np.exp(_log_softmax(scores))
    right = np.flatnonzero((y >= 0) & (y < error.shape[1]))
    error[right, y[right]] -= 1
    dense("readout", error, post)
    error = (error @ model["readout"][0]) * (post > 0)
    dense("post", error, pool)
    error = (error @ model["post"][0])[block["g"]]
    for k in reversed(range(layers)):
        x, inner, outer = held[k]
        error = error * (outer > 0)
        dense(f"conv{k}.1", error, inner)
        error = (error @ model[f"conv{k}.1"][0]) * (inner > 0)
        bias = error.sum(0)
        error = error + _add(src, error[dst], n)
        found[f"conv{k}.0.weight"], found[f"conv{k}.0.bias"] = error.T @ x, bias
        error = error @ model[f"conv{k}.0"][0]
    dense("pre", error, block["x"].reshape(n, -1))
    return found
