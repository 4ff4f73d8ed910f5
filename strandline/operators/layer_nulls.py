"""Nulls of the shared direction of a layer: sign flips, partners dealt anew, split halves.

A layer's rows are dealt to blocks of bounded size by a hash, and no block is a whole layer
unless the layer is small. Each block makes, for every draw, its share of the draw's sums:
of signed deltas, of unit deltas under new partners, of both halves. Shares are added up as
matrices (draws x coordinates). Sign flips then go once more through the blocks, since a
row's alignment needs the draw's whole sum; alignment with the others and coherence follow
from inner products with it, without pairs of rows.

Draws come from a hash of (draw, number), which SQL can state as well: a sign is one bit of
it, an order of rows sorts by it. Partners and halves are drawn inside blocks; a layer (or a
family) above BLOCK rows is dealt to other blocks in each of EPOCHS epochs, so that each row
may meet any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators import vectors as V
from strandline.operators.lineage import cut

PRIME = 2_147_483_647
DRAWS, SPLITS = 2000, 1000
BLOCK, EPOCHS, CHUNK, FAN = 1024, 20, 250, 16
#: The draws of each kind start at another place of the hash.
KINDS = {"signs": 0, "pooled": 1_000_003, "family": 2_000_003, "split": 3_000_017, "deal": 4_000_037}


def hashed(draw, number):
    """A number below PRIME for each (draw, number); numpy arrays of int64."""
    x = (number * 48271 + draw * 69621 + 11) % PRIME
    t = (x * x + draw * 16807 + 40692) % PRIME
    return (t * t + x) % PRIME


def hashed_column(draw: Column, number: Column) -> Column:
    x = (number * 48271 + draw * 69621 + 11) % PRIME
    t = (x * x + draw * 16807 + 40692) % PRIME
    return (t * t + x) % PRIME


def hashed_sql(draw: str, number: str) -> str:
    """The same in SQL; draw and number are expressions of 64 bits."""
    x = f"((({number}) * 48271 + ({draw}) * 69621 + 11) % {PRIME})"
    t = f"(({x} * {x} + ({draw}) * 16807 + 40692) % {PRIME})"
    return f"(({t} * {t} + {x}) % {PRIME})"


def signs(kind: str, draws: np.ndarray, number: np.ndarray) -> np.ndarray:
    """+1 or -1 of each draw (rows) and number (columns)."""
    return ((hashed(draws[:, None] + KINDS[kind], number[None, :]) >> 16) & 1) * 2.0 - 1


def orders(kind: str, draws: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Of each draw the places of ascending numbers in hash order."""
    return np.argsort(hashed(draws[:, None] + KINDS[kind], number[None, :]), axis=1, kind="stable")


def cosine(xx: np.ndarray, yy: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """From squared norms and inner products; NaN where a vector has no length."""
    scale = np.sqrt(np.maximum(xx, 0) * np.maximum(yy, 0))
    return np.divide(xy, scale, out=np.full(np.broadcast(xy, scale).shape, np.nan), where=scale > 0)


# -- blocks -----------------------------------------------------------------------------


def _units(d: np.ndarray) -> np.ndarray:
    size = np.sqrt((d * d).sum(axis=1, keepdims=True))
    return np.divide(d, size, out=np.zeros_like(d), where=size > 0)


def in_blocks(rows: DataFrame, group: list[str], block: int, epochs: int) -> DataFrame:
    """rows with epoch, epochs and block: small groups once, as one block; larger ones in
    each epoch in other blocks."""
    n = rows.groupBy(*group).agg(F.ceil(F.count("*") / block).alias("blocks"))
    many = rows.join(n, group).withColumn("epochs", F.when(F.col("blocks") > 1, epochs).otherwise(1))
    each = many.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    return each.withColumn("block", hashed_column(F.col("epoch").cast("long") + KINDS["deal"], F.col("number")) % F.col("blocks"))


_SHARE = "kind string, chunk int, draws array<int>, sums binary, loo array<double>, known array<long>"


def _share(layer, kind: str, chunk: int, draws: np.ndarray, sums: np.ndarray, loo: np.ndarray, known: np.ndarray) -> tuple:
    return layer, kind, chunk, draws.astype(np.int32), np.ascontiguousarray(sums).tobytes(), loo, known.astype(np.int64)


def _table(rows: list[tuple], layer: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[layer, "kind", "chunk", "draws", "sums", "loo", "known"])


def _of_epoch(pdf: pd.DataFrame, draws: int) -> Iterator[tuple[int, np.ndarray]]:
    """Chunks of the draws that belong to a block's epoch."""
    epoch, epochs = int(pdf["epoch"].iloc[0]), int(pdf["epochs"].iloc[0])
    for chunk in range(-(-draws // CHUNK)):
        every = np.arange(chunk * CHUNK, min(draws, (chunk + 1) * CHUNK), dtype=np.int64)
        own = every[every % epochs == epoch]
        if len(own):
            yield chunk, own


def _rows_of(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    pdf = pdf.sort_values("number")
    return pdf, pdf["number"].to_numpy(np.int64), np.stack(pdf["p"]) - np.stack(pdf["h"])


def flipped_sums(rows: DataFrame, layer: str, kind: str, draws: int) -> DataFrame:
    """Shares of the sums of signed deltas and of signed unit deltas, side by side."""
    of_layer = dict(rows.dtypes)[layer]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, number, d = _rows_of(pdf)
        both, out = np.concatenate([d, _units(d)], axis=1), []
        for chunk in range(-(-draws // CHUNK)):
            own = np.arange(chunk * CHUNK, min(draws, (chunk + 1) * CHUNK), dtype=np.int64)
            out.append(_share(pdf[layer].iloc[0], kind, chunk, own, signs(kind, own, number) @ both, np.zeros(len(own)), np.zeros(len(own))))
        return _table(out, layer)

    return rows.groupBy(layer, "block").applyInPandas(run, f"{layer} {of_layer}, {_SHARE}")


def dealt_sums(rows: DataFrame, layer: str, group: list[str], kind: str, draws: int) -> DataFrame:
    """Shares of unit deltas' sums, and of the alignments, under partners in hash order. The
    sum of all deltas doesn't depend on who is whose partner: a row brings its inner products
    with it (hs, ps), its squared length (ss) and those of its own vectors (hh, pp)."""
    of_layer = dict(rows.dtypes)[layer]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("number")
        number, h, p = pdf["number"].to_numpy(np.int64), np.stack(pdf["h"]), np.stack(pdf["p"])
        hs, ps, hh, pp = (pdf[c].to_numpy(float) for c in ("hs", "ps", "hh", "pp"))
        ss, out = float(pdf["ss"].iloc[0]), []
        for chunk, own in _of_epoch(pdf, draws):
            loo, known, sums = np.zeros(len(own)), np.zeros(len(own)), np.zeros((len(own), h.shape[1]))
            for i, order in enumerate(orders(kind, own, number)):
                d = p[order] - h
                dd, g = pp[order] - 2 * (p[order] * h).sum(axis=1) + hh, ps[order] - hs
                a = cosine(dd, ss - 2 * g + dd, g - dd)
                loo[i], known[i], sums[i] = np.nansum(a), np.isfinite(a).sum(), _units(d).sum(axis=0)
            out.append(_share(pdf[layer].iloc[0], kind, chunk, own, sums, loo, known))
        return _table(out, layer)

    return rows.groupBy(*group, "epoch", "block").applyInPandas(run, f"{layer} {of_layer}, {_SHARE}")


def split_sums(rows: DataFrame, layer: str, kind: str, draws: int) -> DataFrame:
    """Shares of the sums of both halves, side by side; an odd row of a block is in neither."""
    of_layer = dict(rows.dtypes)[layer]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, number, d = _rows_of(pdf)
        half, out = len(d) // 2, []
        for chunk, own in _of_epoch(pdf, draws):
            place = orders(kind, own, number)
            sums = np.concatenate([d[place[:, :half]].sum(axis=1), d[place[:, half : 2 * half]].sum(axis=1)], axis=1)
            out.append(_share(pdf[layer].iloc[0], kind, chunk, own, sums, np.zeros(len(own)), np.zeros(len(own))))
        return _table(out, layer)

    return rows.groupBy(layer, "epoch", "block").applyInPandas(run, f"{layer} {of_layer}, {_SHARE}")


def added_up(shares: DataFrame, layer: str) -> DataFrame:
    """One row for each layer, kind and chunk of draws: sums of shares, in two steps, of which
    the first has FAN tasks a sum."""
    of_layer = dict(shares.dtypes)[layer]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        known = {int(d): i for i, d in enumerate(sorted({d for ds in pdf["draws"] for d in ds}))}
        width = len(pdf["sums"].iloc[0]) // 8 // len(pdf["draws"].iloc[0])
        sums, loo, n = np.zeros((len(known), width)), np.zeros(len(known)), np.zeros(len(known))
        for ds, blob, a, k in zip(pdf["draws"], pdf["sums"], pdf["loo"], pdf["known"]):
            at = [known[int(d)] for d in ds]
            sums[at] += np.frombuffer(blob).reshape(len(ds), width)
            loo[at] += a
            n[at] += k
        return _table([_share(pdf[layer].iloc[0], pdf["kind"].iloc[0], int(pdf["chunk"].iloc[0]), np.array(list(known)), sums, loo, n)], layer)

    ddl = f"{layer} {of_layer}, {_SHARE}"
    some = shares.withColumn("part", F.pmod(F.xxhash64("sums"), F.lit(FAN))).groupBy(layer, "kind", "chunk", "part").applyInPandas(run, ddl)
    return some.groupBy(layer, "kind", "chunk").applyInPandas(run, ddl)


def flipped_alignments(rows: DataFrame, sums: DataFrame, layer: str, kind: str) -> DataFrame:
    """(layer, draw, loo, known): summed alignments of each block with the flipped sums."""
    of_layer = dict(rows.dtypes)[layer]
    blocks = rows.select(F.col(layer).alias("layer_"), F.col("block").alias("block_")).distinct()

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        _, number, d = _rows_of(left)
        dd, out = (d * d).sum(axis=1), []
        for draws, blob in zip(right["draws"], right["sums"]):
            own = np.asarray(draws, np.int64)
            total = np.frombuffer(blob).reshape(len(own), -1)[:, : d.shape[1]]
            g, ss = signs(kind, own, number) * (total @ d.T), (total * total).sum(axis=1)
            a = cosine(dd[None, :], ss[:, None] - 2 * g + dd, g - dd)
            out.append(pd.DataFrame({layer: left[layer].iloc[0], "draw": own, "loo": np.nansum(a, axis=1), "known": np.isfinite(a).sum(axis=1)}))
        return pd.concat(out)

    right = sums.select(F.col(layer).alias("layer_"), "draws", "sums").join(blocks, "layer_")
    return rows.groupBy(layer, "block").cogroup(right.groupBy("layer_", "block_")).applyInPandas(run, f"{layer} {of_layer}, draw long, loo double, known long")


def _drawn(sums: DataFrame, layer: str) -> DataFrame:
    """(layer, kind, draw, loo, coherence): of each draw the mean alignment, and the length of
    the summed unit deltas (of split halves: the cosine of both)."""
    of_layer = dict(sums.dtypes)[layer]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for _, r in pdf.iterrows():
                x = np.frombuffer(r["sums"]).reshape(len(r["draws"]), -1)
                half = x.shape[1] // 2
                if r["kind"] == "split":
                    value = cosine((x[:, :half] ** 2).sum(axis=1), (x[:, half:] ** 2).sum(axis=1), (x[:, :half] * x[:, half:]).sum(axis=1))
                else:
                    value = np.sqrt(((x[:, half:] if r["kind"] == "signs" else x) ** 2).sum(axis=1))
                known = np.asarray(r["known"], float)
                loo = np.divide(np.asarray(r["loo"], float), known, out=np.full(len(known), np.nan), where=known > 0)
                yield pd.DataFrame({layer: r[layer], "kind": r["kind"], "draw": np.asarray(r["draws"], np.int64), "loo": loo, "value": value})

    return sums.mapInPandas(run, f"{layer} {of_layer}, kind string, draw long, loo double, value double")


def drawn_facts(pairs: DataFrame, key: str, layer: str, family: str, h: str, p: str, *, draws: int = DRAWS, splits: int = SPLITS, block: int = BLOCK, epochs: int = EPOCHS) -> DataFrame:
    """(layer, kind, draw, loo, value): every draw's mean leave-one-out alignment and its
    coherence, for kinds signs, pooled and family; of kind split the halves' cosine."""
    base = pairs.select(layer, family, F.pmod(F.col(key).cast("long"), F.lit(PRIME)).alias("number"), F.col(h).alias("h"), F.col(p).alias("p"))
    total = V.sum_vector(V.deltas(base, "h", "p"), layer, "delta", "s")
    n = base.groupBy(layer).agg(F.count("*").alias("n"))
    dots = {"hs": V.dot("h", "s"), "ps": V.dot("p", "s"), "ss": V.dot("s", "s"), "hh": V.dot("h", "h"), "pp": V.dot("p", "p")}
    rows = cut(base.join(total, layer).withColumns(dots).drop("s"))
    pooled, inside = in_blocks(rows, [layer], block, epochs), in_blocks(rows, [layer, family], block, epochs)
    first = pooled.where("epoch = 0")
    shares = flipped_sums(first, layer, "signs", draws)
    for part in (dealt_sums(pooled, layer, [layer], "pooled", draws), dealt_sums(inside, layer, [layer, family], "family", draws), split_sums(pooled, layer, "split", splits)):
        shares = shares.unionByName(part)
    sums = cut(added_up(shares, layer))
    aligned = flipped_alignments(first, sums.where("kind = 'signs'"), layer, "signs").groupBy(layer, "draw").agg((F.sum("loo") / F.sum("known")).alias("flipped"))
    drawn = _drawn(sums, layer).join(aligned.withColumn("kind", F.lit("signs")), [layer, "kind", "draw"], "left").join(n, layer)
    loo = F.when(F.col("kind") == "signs", F.col("flipped")).otherwise(F.col("loo"))
    value = F.when(F.col("kind") == "split", F.col("value")).otherwise(F.col("value") / F.col("n"))
    return drawn.select(layer, "kind", "draw", loo.alias("loo"), value.alias("value"))


NULLS = {"signs": "signflip", "family": "mismatch", "pooled": "mismatchpool"}


def layer_statistics(pairs: DataFrame, key: str, layer: str, family: str, h: str, p: str, **options) -> DataFrame:
    """(layer, n, 28 statistics): how alike the deltas of a layer point, how stable that is
    under split halves, and medians and p values, (hits + 1) / (draws + 1), of three nulls."""
    facts = cut(V.direction_facts(V.deltas(pairs, h, p), key, layer, "delta"))
    drawn = drawn_facts(pairs, key, layer, family, h, p, **options)
    fine = lambda c: F.when(~F.isnan(c), c)
    drawn = drawn.select(layer, "kind", fine(F.col("loo")).alias("loo"), fine(F.col("value")).alias("value"))
    both = drawn.join(facts.select(layer, "loo_mean", "coherence"), layer)
    of = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
    out = [F.percentile(of("split", "value"), F.lit(q)).alias(name) for name, q in (("split_median", 0.5), ("split_low", 0.025), ("split_high", 0.975))]
    for kind, name in NULLS.items():
        for c, real, label in (("loo", "loo_mean", "loo"), ("value", "coherence", "coherence")):
            out.append(F.percentile(of(kind, c), F.lit(0.5)).alias(f"null_{name}_{label}"))
            hits, n = F.count_if(of(kind, c) >= F.col(real)), F.count(of(kind, c))
            out.append(F.when((n > 0) & F.max(real).isNotNull(), (hits + 1) / (n + 1)).alias(f"p_{name}_{label}"))
    return facts.join(both.groupBy(layer).agg(*out), layer)
