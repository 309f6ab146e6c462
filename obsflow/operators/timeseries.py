"""Pulse, timing and progress over ordered signals and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsflow.plans.ordered import (
    Fold, Ordered, after, before, best, lag, last_known, lead, row_number, running_sum, total,
)


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda t, s: t + F.coalesce(s["v"], F.lit(0.0)))


def onset_strength(df: DataFrame, keys, i: str, x: str, taps: int = 21) -> DataFrame:
    """Rises of a signal above their moving average, centred on zero.

    ``i`` must be consecutive within a key.  The moving average counts missing
    neighbours at the ends as zero.
    """
    o = Ordered(df, keys, [i]).with_columns(_p=lag(x))
    o = o.columns(_r=F.when(F.col("_p").isNotNull(), F.greatest(F.lit(0.0), F.col(x) - F.col("_p")))).where(F.col("_r").isNotNull())
    half = taps // 2
    o = o.with_columns(_b=before("_r", half), _a=after("_r", half))
    o = o.columns(_c=F.greatest(F.lit(0.0), F.col("_r") - (_sum(F.col("_b")) + F.col("_r") + _sum(F.col("_a"))) / taps))
    o = o.with_columns(_m=total(F.sum, "_c"), _n=total(F.count, F.lit(1), merge=F.sum))
    return o.columns(onset=F.col("_c") - F.col("_m") / F.col("_n")).result.select(*keys, i, "onset")


def spectral_onset(signal: DataFrame, keys, i: str, x: str, rate: int = 11025, size: int = 1024, hop: int = 128, low: int = 4, high: int = 372) -> DataFrame:
    """Positive log spectral flux of a sampled signal, one value per hop.

    Samples are cut into blocks of whole hops; each block also receives the samples its
    last windows reach into, so blocks are independent and of bounded size.
    """
    import numpy as np
    import pandas as pd

    block = hop * 256
    reach = size + hop
    b = F.floor(F.col(i) / block)
    d = signal.select(*keys, F.col(i).cast("bigint").alias("i"), F.col(x).cast("double").alias("x"),
                      F.explode(F.when((F.col(i) % block < reach) & (b > 0), F.array(b - 1, b)).otherwise(F.array(b))).alias("_b"))

    def flux(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        start = int(pdf["_b"].iloc[0]) * block
        v = pdf["x"].to_numpy()
        rows = []
        if len(v) >= size:
            windows = np.lib.stride_tricks.sliding_window_view(v, size)[::hop][:257]
            spectrum = np.log1p(np.abs(np.fft.rfft(windows * np.hanning(size), axis=1))[:, low:high] * 10)
            rise = np.maximum(0, np.diff(spectrum, axis=0)).mean(axis=1)
            rows = [(start // hop + k, float(r)) for k, r in enumerate(rise)]
        out = pd.DataFrame(rows, columns=["frame", "flux"])
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "frame", "flux"]]

    kinds = ", ".join(f"{k} {signal.schema[k].dataType.simpleString()}" for k in keys)
    return d.groupBy(*keys, "_b").applyInPandas(flux, f"{kinds}, frame bigint, flux double")


def autocorrelation(df: DataFrame, keys, i: str, x: str, max_lag: int) -> DataFrame:
    """Normalised autocorrelation for lags 0..max_lag of a signal with consecutive ``i``.

    Products are summed per lag on the map side; no self-join is made.
    """
    o = Ordered(df, keys, [i]).with_columns(_a=after(x, max_lag), _n=total(F.count, F.lit(1), merge=F.sum))
    pairs = F.concat(F.array(F.struct(F.col(x).alias("v"))), F.col("_a"))
    d = o.result.select(*keys, "_n", F.col(x).alias("_x"), F.posexplode_outer(pairs).alias("lag", "_s"))
    g = d.groupBy(*keys, "lag").agg(F.sum(F.col("_x") * F.col("_s.v")).alias("_p"), F.max("_n").alias("_n"))
    energy = g.filter("lag = 0").select(*keys, F.col("_p").alias("_e"))
    g = g.join(energy, keys)
    ac = F.when(F.col("_e") >= 1e-8, F.col("_p") / F.col("_e") * F.col("_n") / F.greatest(F.lit(1), F.col("_n") - F.col("lag")))
    return g.select(*keys, "lag", ac.alias("ac"))


def period_score(ac: DataFrame, keys, bins_per_minute: float, lo: int = 60, hi: int = 200) -> DataFrame:
    """Score of every tempo from ``lo`` to ``hi`` in steps of 0.1.

    Autocorrelation at one, two and three periods, interpolated, with a broad preference
    around 120.  A key's values (bounded by the largest lag) form one array.
    """
    a = ac.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("lag", "ac"))), lambda s: s["ac"]).alias("_ac"))
    a = a.withColumn("_j", F.explode(F.sequence(F.lit(lo * 10), F.lit(hi * 10))))
    tempo = F.col("_j") / 10
    at = lambda k: F.get("_ac", k)

    def interpolate(point):
        c = F.rint(point).cast("int")
        d = point - c
        return at(c) + d * (at(c + 1) - at(c - 1)) / 2 + d * d * (at(c + 1) - 2 * at(c) + at(c - 1)) / 2

    period = F.lit(bins_per_minute) / tempo
    score = sum(w * interpolate(period * m) for m, w in ((1, F.lit(1.0)), (2, F.lit(0.5)), (3, F.lit(0.25))))
    prior = F.exp(F.lit(-0.5) * F.pow(F.log(tempo / 120) / 0.75, F.lit(2.0)))
    return a.select(*keys, tempo.alias("tempo"), (score * prior).alias("score"))


def segment_consensus(scores: DataFrame, keys, segment: str, min_score: float = 0.08, tol: float = 0.04) -> DataFrame:
    """Tempo with the best mean score, and whether every segment agrees on its own."""
    mean = scores.groupBy(*keys, "tempo").agg(F.avg("score").alias("_s"))
    top = best(mean, keys, [-F.col("_s"), "tempo"]).filter(F.col("_s") >= min_score).select(*keys, F.bround("tempo", 1).alias("bpm"))
    own = best(scores.select(*keys, segment, "tempo", "score"), [*keys, segment], [-F.col("score"), "tempo"])
    ok = F.bool_and(F.abs(F.col("tempo") - F.col("bpm")) / F.col("bpm") < tol)
    out = own.join(top, keys).groupBy(*keys, "bpm").agg(ok.alias("consistent"))
    return out.select(*keys, "bpm", "consistent", F.bround(F.col("bpm") / 2, 1).alias("half"), F.bround(F.col("bpm") * 2, 1).alias("double"))


def _timed(o: Ordered, t: str, until: str, bars: str, bpm: float, beats: float, interval: float) -> Ordered:
    o = o.with_columns(_nt=lead(t))
    seen = F.abs(F.col(until) - F.col("_nt")) <= max(0.15, interval * 1.1)
    return o.columns(observed=F.when(seen & (F.col("_nt") != F.col(t)), F.col("_nt") - F.col(t)),
                     expected=F.when(F.col(bars) > 0, F.col(bars) * beats * 60 / bpm))


def expected_duration(lines: DataFrame, keys, order, t: str, until: str, bars: str, bpm: float, beats: float, interval: float) -> DataFrame:
    """How long each line was shown, where its end was seen, and how long it should take."""
    o = _timed(Ordered(lines, keys, order), t, until, bars, bpm, beats, interval)
    return o.result.drop("_nt")


def timed_repeats(lines: DataFrame, keys, order, t: str, until: str, bars: str, bpm: float, beats: float, interval: float) -> DataFrame:
    """Copies of lines shown for two to four times their length, where neighbours confirm the tempo.

    Returns all lines with their times; copies have ``copy`` > 0.
    """
    if not (30 <= bpm <= 300 and 1 <= beats <= 16):
        raise ValueError("bpm must be 30 to 300 and beats 1 to 16")
    o = _timed(Ordered(lines, keys, order), t, until, bars, bpm, beats, interval)
    single = F.abs(F.col("observed") - F.col("expected")) <= F.greatest(F.lit(interval * 1.25), F.col("expected") * 0.06)
    o = o.with_columns(_rn=row_number(), _next=lead(t))
    edge = (F.col("_rn") == 1) | F.col("_next").isNull()
    o = o.columns(_edge=edge, _one=F.coalesce(single, F.lit(False)) & ~edge)
    o = o.with_columns(_b=before("_one", 3), _a=after("_one", 3))
    n = lambda c: F.size(F.filter(c, lambda s: s["v"]))
    passes = F.rint(F.col("observed") / F.col("expected"))
    close = F.abs(F.col("observed") - passes * F.col("expected")) <= F.greatest(F.lit(interval * 1.25), F.col("expected") * 0.06)
    ok = ~F.col("_edge") & passes.between(2, 4) & close & (n("_b") + n("_a") >= 3) & (n("_b") > 0) & (n("_a") > 0)
    o = o.columns(_p=F.when(F.coalesce(ok, F.lit(False)), passes.cast("int")).otherwise(1))
    d = o.result.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_p") - 1)))
    many = F.col("_p") > 1
    new_t = F.when(many & (F.col("copy") > 0), F.bround(F.col(t) + F.col("observed") * F.col("copy") / F.col("_p"), 3)).otherwise(F.col(t))
    new_u = F.when(many, F.bround(F.col(t) + F.col("observed") * (F.col("copy") + 1) / F.col("_p"), 3)).otherwise(F.col(until))
    out = d.withColumns({"_t": new_t, "_u": new_u})
    return out.select(*[F.col("_t").alias(c) if c == t else F.col("_u").alias(c) if c == until else F.col(c) for c in lines.columns], "copy")


def net_active_time(log: DataFrame, keys, order, ts: str, op: str) -> DataFrame:
    """Elapsed time less pauses; a pause runs while one is requested and nothing is active.

    ``op``: begin, end, pause or resume.
    """
    o = Ordered(log, keys, order)
    o = o.columns(_d=F.when(F.col(op) == "begin", 1).when(F.col(op) == "end", -1).otherwise(0),
                  _q=F.when(F.col(op).isin("pause", "resume"), F.col(op) == "pause"))
    o = o.with_columns(_active=running_sum("_d"), _req=last_known("_q"), _nt=lead(ts))
    held = F.coalesce(F.col("_req"), F.lit(False)) & (F.col("_active") <= 0)
    g = o.result.groupBy(*keys).agg((F.max(ts) - F.min(ts)).alias("_e"), F.coalesce(F.sum(F.when(held, F.col("_nt") - F.col(ts))), F.lit(0.0)).alias("paused_s"))
    return g.select(*keys, (F.col("_e") - F.col("paused_s")).alias("active_s"), "paused_s")


class _Clock(Fold):
    def __init__(self, duration, schema):
        self.duration = duration
        self.schema = f"{schema}, position double"

    def start(self):
        return (None, 0.0, 1.0, False)

    def step(self, core, acc, row, emit):
        now, op, value = row[:3]
        anchor_t, anchor, speed, playing = core
        d = self.duration
        pos = min(d, anchor + ((now - anchor_t) * speed if playing and anchor_t is not None else 0.0))
        if op == "seek" and value is not None:
            pos = min(d, max(0.0, value))
        elif op == "play":
            pos, playing = (0.0 if pos >= d else pos), True
        elif op == "pause":
            playing = False
        elif op == "speed" and value is not None and 0.25 <= value <= 2:
            speed = value
        emit(*row[3:], pos)
        return (now, pos, speed, playing)


def playback_position(log: DataFrame, keys, order, ts: str, op: str, value: str, duration: float) -> DataFrame:
    """Position of each session's clock after every control event (play, pause, seek, speed)."""
    schema = ", ".join(f"`{c}` {log.schema[c].dataType.simpleString()}" for c in order)
    return Ordered(log, keys, order).fold(_Clock(duration, schema), [ts, op, value, *order])


def progress_rollup(df: DataFrame, keys, ts: str, tie: list[str], phase: str, completed: str, total_: str, saved: str, now: Column, stale_after: float = 10.0) -> DataFrame:
    """Latest report of each job, the finished share, and whether it has gone quiet."""
    last = df.groupBy(*keys).agg(F.max_by(F.struct(ts, phase, completed, total_, saved), F.struct(ts, *tie)).alias("_l"))
    l = F.col("_l")
    return last.select(*keys, l[phase].alias("phase"), l[completed].alias("completed"), l[total_].alias("total"), l[saved].alias("saved"),
                       F.when(l[total_] > 0, l[completed] / l[total_]).otherwise(0.0).alias("fraction"), (now - l[ts] >= stale_after).alias("stale"))
