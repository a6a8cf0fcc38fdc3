"""Vector, distribution and token-array expressions over array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(c) -> Column:
    return F.aggregate(_col(c), F.lit(0.0), lambda a, x: a + x.cast("double"))


def dot(a, b) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(c) -> Column:
    return F.sqrt(dot(c, c))


def cosine(a, b, eps: float = 1e-12) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


def l2_normalize(c, eps: float = 1e-12) -> Column:
    return F.transform(_col(c), lambda x: x.cast("double") / F.greatest(norm(c), F.lit(eps)))


def log_sum_exp(c) -> Column:
    top = F.array_max(_col(c)).cast("double")
    return top + F.ln(F.aggregate(_col(c), F.lit(0.0), lambda a, x: a + F.exp(x.cast("double") - top)))


def softmax_at(logits, index) -> Column:
    """Probability of a 0-based index; null outside."""
    return F.exp(F.get(_col(logits), _col(index)).cast("double") - log_sum_exp(logits))


def argmax(c) -> Column:
    """0-based index of the first largest value."""
    return (F.array_position(_col(c), F.array_max(_col(c))) - 1).cast("int")


def rank_of(logits, index) -> Column:
    """1 + the number of values above the one at index; NaN is above nothing."""
    own = F.get(_col(logits), _col(index))
    return F.size(F.filter(_col(logits), lambda x: ~F.isnan(x) & (x > own))) + 1


def all_finite(c) -> Column:
    return F.forall(_col(c), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def in_top(logits, index, k: int) -> Column:
    """Whether the index is among the k best (at most as many as there are)."""
    return rank_of(logits, index) <= F.least(F.lit(k), F.size(_col(logits)))


def kl_from_logits(p, q) -> Column:
    """KL(softmax p || softmax q), at least 0."""
    a, b = log_sum_exp(p), log_sum_exp(q)
    terms = F.zip_with(_col(p), _col(q), lambda x, y: F.exp(x - a) * ((x - a) - (y - b)))
    return F.greatest(F.lit(0.0), total(terms))


def probability_kl(p, q, eps: float = 1e-8) -> Column:
    """KL of two probability rows after clamping at eps and renormalising."""
    clamp = lambda c: F.transform(_col(c), lambda x: F.greatest(x.cast("double"), F.lit(eps)))
    a, b = clamp(p), clamp(q)
    sa, sb = total(a), total(b)
    return total(F.zip_with(a, b, lambda x, y: (x / sa) * (F.ln(x / sa) - F.ln(y / sb))))


def pad_trim(c, n: int, pad) -> Column:
    """Cut to n, filled at the right with pad."""
    cut = F.slice(_col(c), 1, n)
    return F.concat(cut, F.array_repeat(F.lit(pad), F.lit(n) - F.size(cut)))


def valid_mask(c, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i < F.size(_col(c)))


def center_crop(c, n: int) -> Column:
    """n values from the middle; the whole array if it is shorter."""
    size = F.size(_col(c))
    return F.when(size <= n, _col(c)).otherwise(F.slice(_col(c), ((size - n) / 2).cast("int") + 1, F.lit(n)))


def random_crop(c, n: int, seed: int, *keys) -> Column:
    """n values from a place drawn by the hash of the keys; the whole array if it is shorter."""
    from quillon.functions.text import stable_hash

    size = F.size(_col(c))
    start = F.conv(F.substring(stable_hash(seed, "crop", *keys), 1, 8), 16, 10).cast("long") % F.greatest(size - n + 1, F.lit(1))
    return F.when(size <= n, _col(c)).otherwise(F.slice(_col(c), start.cast("int") + 1, F.lit(n)))


def exact_segment(c, start, n: int) -> Column:
    """n values from start (0-based); null where the array does not hold all of them."""
    inside = (_col(start) >= 0) & (_col(start) + n <= F.size(_col(c)))
    return F.when(inside, F.slice(_col(c), F.when(inside, _col(start) + 1).otherwise(1), F.lit(n)))


def shift_right(codes, pad: int) -> Column:
    """The plain shift: every token moves one place on, pad comes first, the last goes."""
    return F.concat(F.array(F.lit(pad)), F.slice(_col(codes), F.lit(1), F.greatest(F.size(_col(codes)) - 1, F.lit(0)))).cast("array<int>")


def token_slice(c, offset, length) -> Column:
    return F.slice(_col(c), _col(offset) + 1, _col(length))


def delay_row(codes, codebook, frames: int, codebooks: int, pad: int) -> Column:
    """Codebook q's row of the delay layout: token t stands in column q + t + 1 of T + Q - 1."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(frames + codebooks - 2)),
        lambda c: F.coalesce(F.when(c - _col(codebook) >= 1, F.get(_col(codes), c - _col(codebook) - 1)), F.lit(pad)),
    )


def undelay_row(row, codebook, frames: int) -> Column:
    """Back from the delay layout: column q + t + 1 to t; what fell off the end is null."""
    return F.transform(F.sequence(F.lit(0), F.lit(frames - 1)), lambda t: F.get(_col(row), t + _col(codebook) + 1))


def multihot(ids, n: int) -> Column:
    """Weights 1/|ids| at the ids, 0 elsewhere."""
    chosen = F.array_distinct(_col(ids))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(F.array_contains(chosen, i), 1.0 / F.size(chosen)).otherwise(0.0))


def equal_weights(ids, size: int | None = None) -> Column:
    """Distinct sorted ids with equal weights; with a size, an id outside 0 to size - 1 (or null)
    is an error."""
    chosen = F.array_sort(F.array_distinct(_col(ids)))
    if size is not None:
        wrong = F.exists(chosen, lambda i: i.isNull() | (i < 0) | (i >= size))
        chosen = F.when(~wrong, chosen).otherwise(F.raise_error(F.concat(F.lit(f"ids outside 0 to {size - 1}: "), F.to_json(chosen))))
    return F.transform(chosen, lambda i: F.struct(i.alias("id"), (F.lit(1.0) / F.size(chosen)).alias("weight")))


def rms_cap(residual, hidden) -> Column:
    """The residual scaled so that its rms is at most that of hidden."""
    rms = lambda c: F.sqrt(dot(c, c) / F.size(_col(c)))
    scale = F.least(F.lit(1.0), rms(hidden) / F.greatest(rms(residual), F.lit(1e-12)))
    return F.transform(_col(residual), lambda x: x * scale)


def peak_normalize(c, least: float = 0.1) -> Column:
    top = F.greatest(F.lit(least), F.array_max(_col(c)))
    return F.transform(_col(c), lambda x: x / top)
