"""Projections, predicates and rule checks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsflow.functions.exprs import finite, unfold

# Fixed values.
VIDEO_HOSTS = ["youtube.com", "www.youtube.com", "m.youtube.com", "youtu.be", "www.youtu.be"]
SHORT_HOSTS = ["youtu.be", "www.youtu.be"]
PATH_PREFIXES = ["shorts", "embed", "live"]
VIDEO_ID = "[A-Za-z0-9_-]{11}"
CANONICAL = "https://www.youtube.com/watch?v="
RESERVED_NAMES = ["CON", "PRN", "AUX", "NUL", "COM0", "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "COM9",
                  "LPT0", "LPT1", "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8", "LPT9"]
DEFAULT_NAME = "Sheet music"
TEMPO_MARK = r"(?i)(?:[♩\x{1D15F}]|\bquarter(?:[ -]note)?|\bq)\s*=\s*(\d{2,3})\b"
LABEL_MARK = r"^[A-Z]\d?$"
# Field, least, most, whole numbers only.
LIMITS = [("bpm", 30.0, 300.0, False), ("beats", 1.0, 16.0, False), ("bars_per_line", 4.0, 16.0, True), ("bar_override", 0.0, 16.0, True),
          ("gap", 0.0, 30.0, False), ("margin", 0.0, 40.0, False), ("title_size", 6.0, 36.0, False), ("height_scale", 0.25, 2.0, False),
          ("tempo_bpm", 0.0, 400.0, False), ("label_length", 0.0, 16.0, False)]
NOTE_FIELDS = {"bass": ["string", "fret", "marks"], "guitar": ["string", "fret", "marks"], "piano": ["step", "alter", "octave", "marks"],
               "drums": ["step", "octave", "drum", "marks"]}
NOTE_TYPES = {"string": "int", "fret": "string", "step": "string", "alter": "int", "octave": "int", "drum": "string", "marks": "string"}


def crop_box(crop: list[Column], w: Column, h: Column) -> Column:
    """Pixel box of a normalized crop, null when the crop is not usable."""
    l, t, r, b = crop
    ok = finite(l) & finite(t) & finite(r) & finite(b) & (l >= 0) & (l < r) & (r <= 1) & (t >= 0) & (t < b) & (b <= 1)
    x0, y0 = (l * w).cast("int"), (t * h).cast("int")
    box = F.struct(x0.alias("x0"), y0.alias("y0"), F.greatest((r * w).cast("int"), x0 + 1).alias("x1"), F.greatest((b * h).cast("int"), y0 + 1).alias("y1"))
    return F.when(F.coalesce(ok, F.lit(False)), box)


def expand_crop(crop: list[Column], dx: float = 0.035, dy: float = 0.075) -> Column:
    l, t, r, b = crop
    ok = finite(l) & finite(t) & finite(r) & finite(b) & (l >= 0) & (l < r) & (r <= 1) & (t >= 0) & (t < b) & (b <= 1)
    out = F.array(F.greatest(F.lit(0.0), l - dx), F.greatest(F.lit(0.0), t - dy), F.least(F.lit(1.0), r + dx), F.least(F.lit(1.0), b + dy))
    return F.when(F.coalesce(ok, F.lit(False)), out)


def canonical_video_url(df: DataFrame, url: str, hosts=VIDEO_HOSTS, short_hosts=SHORT_HOSTS, prefixes=PATH_PREFIXES, param="v",
                        id_pattern=VIDEO_ID, canonical=CANONICAL) -> DataFrame:
    """Item identifier and canonical link of an address, or the reason there is none."""
    u = F.trim(url)
    host = F.lower(F.try_parse_url(u, F.lit("HOST")))
    path = F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit(""))
    part = F.split(path, "/")
    short = F.regexp_extract(path, "^/*([^/]*)", 1)
    item = (F.when(host.isin(short_hosts), short).when(F.get(part, F.lit(1)).isin(prefixes) & (F.size(part) > 2), F.get(part, F.lit(2)))
            .otherwise(F.try_parse_url(u, F.lit("QUERY"), F.lit(param))))
    scheme = F.lower(F.try_parse_url(u, F.lit("PROTOCOL")))
    error = (F.when(~F.coalesce(scheme.isin("http", "https") & host.isin(hosts), F.lit(False)), "unsupported address")
             .when(~F.coalesce(item.rlike(f"^{id_pattern}$"), F.lit(False)), "no single item"))
    out = df.withColumn("error", error)
    return out.withColumns({"item_id": F.when(F.col("error").isNull(), item), "canonical": F.when(F.col("error").isNull(), F.concat(F.lit(canonical), item))})


def safe_name(c: Column, default: str = DEFAULT_NAME) -> Column:
    """File name safe on every system."""
    clean = F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]', "_")
    clean = F.substring(F.regexp_replace(clean, r"^[. ]+|[. ]+$", ""), 1, 100)
    clean = F.when(clean == "", default).otherwise(clean)
    stem = F.upper(F.substring_index(clean, ".", 1))
    return F.when(stem.isin(RESERVED_NAMES), F.concat(F.lit("_"), clean)).otherwise(clean)


def range_rules(df: DataFrame, keys, fields: list[str], rules=LIMITS) -> DataFrame:
    """One row per value that breaks its field's rule: missing, not finite, out of range, not whole."""
    checks = []
    for field, lo, hi, whole in rules:
        if field not in fields:
            continue
        v = F.col(field).cast("double")
        rule = F.when(~finite(v), "not finite").when(~v.between(lo, hi), "out of range")
        if whole:
            rule = rule.when(v != F.floor(v), "not whole")
        checks.append(F.when(rule.isNotNull(), F.struct(F.lit(field).alias("field"), v.alias("value"), rule.alias("rule"))))
    return df.select(*keys, unfold(F.array_compact(F.array(*checks))).alias("_r")).filter("_r is not null").select(*keys, "_r.*")


def schema_check(df: DataFrame, keys, json: str, schema: dict, path: str = "response") -> DataFrame:
    """Differences between JSON values and a closed schema, one row per path.

    ``schema`` nests {type, properties, items, enum}.  A value of the wrong type is reported
    and not entered.  Texts are parsed once; the problems of a text are one array.
    """
    rows = df.select(*keys, F.try_parse_json(json).alias("_v"))
    found = F.when(F.col("_v").isNull(), F.array(_problem(F.lit(path), F.lit("malformed")))).otherwise(_problems(F.col("_v"), F.lit(path), schema))
    return rows.select(*keys, F.explode(found).alias("_p")).select(*keys, "_p.*")


_KINDS = {"object": "OBJECT", "array": "ARRAY", "string": "STRING", "boolean": "BOOLEAN"}
_NONE = "array<struct<path:string,issue:string>>"


def _problem(path: Column, issue: Column) -> Column:
    return F.struct(path.alias("path"), issue.alias("issue"))


def _problems(v: Column, path: Column, schema: dict) -> Column:
    """Problems of one value and of what it holds."""
    kind = schema["type"]
    actual = F.schema_of_variant(v)
    whole = (actual == "BIGINT") | actual.rlike(r"^DECIMAL\(\d+,0\)$")
    if kind == "number":
        ok = (actual == "BIGINT") | F.startswith(actual, F.lit("DECIMAL")) | actual.isin("DOUBLE", "FLOAT")
    elif kind == "integer":
        ok = whole
    else:
        ok = F.startswith(actual, F.lit(_KINDS[kind]))
    none = F.array().cast(_NONE)
    one = lambda cond, issue: F.when(cond, F.array(_problem(path, F.lit(issue)))).otherwise(none)
    parts = [one(~F.coalesce(ok, F.lit(False)), f"expected {kind}")]
    if "enum" in schema:
        parts.append(F.when(ok, one(~v.cast("string").isin(schema["enum"]), "unsupported value")).otherwise(none))
    if kind == "object":
        have = F.array_sort(F.json_object_keys(F.to_json(v)))
        inner = [one(have != F.array(*[F.lit(k) for k in sorted(schema["properties"])]), "missing or unexpected fields")]
        for key, child in schema["properties"].items():
            sub = F.try_variant_get(v, f"$.{key}", "variant")
            inner.append(F.when(sub.isNotNull(), _problems(sub, F.concat(path, F.lit(f".{key}")), child)).otherwise(none))
        parts.append(F.when(ok, F.concat(*inner)).otherwise(none))
    elif kind == "array":
        each = F.transform(v.cast("array<variant>"), lambda x, i: _problems(x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), schema["items"]))
        parts.append(F.when(ok, F.coalesce(F.flatten(each), none)).otherwise(none))
    return F.concat(*parts)


def compact(notes: Column, instrument: str) -> Column:
    """Notes with only the fields an instrument uses."""
    return F.transform(notes, lambda n: F.struct(*[n[f].alias(f) for f in NOTE_FIELDS[instrument]]))


def fill_defaults(notes: Column, have: list[str]) -> Column:
    """Notes with every field; absent or null ones are '' or 0."""
    def full(n):
        return F.struct(*[(F.coalesce(n[f], _zero(t)) if f in have else _zero(t)).alias(f) for f, t in NOTE_TYPES.items()])

    return F.transform(notes, full)


def _zero(kind: str) -> Column:
    return F.lit("") if kind == "string" else F.lit(0).cast(kind)


def lift_marks(events: Column, tempo: Column, rehearsal: Column) -> Column:
    """Struct (tempo_bpm, rehearsal, marks) after moving tempo and section text out of event marks.

    ``events`` is an array of structs with onset and marks, in order; the first find wins
    unless the bar already has a value.
    """
    def split(e):
        m = F.coalesce(e["marks"], F.lit(""))
        found = F.regexp_extract(m, TEMPO_MARK, 1)
        left = F.trim(F.regexp_replace(F.trim(F.concat_ws("", F.regexp_extract(m, r"(?s)^(.*?)" + _plain(TEMPO_MARK), 1), F.regexp_extract(
            m, r"(?s)^.*?" + _plain(TEMPO_MARK) + r"(.*)$", 2))), r"(?i)\s*\btempo\b\s*$", ""))
        text = F.when(found != "", left).otherwise(m)
        label = (e["onset"] == 0) & text.rlike(LABEL_MARK)
        return F.struct(F.when(found != "", found.cast("int")).alias("bpm"), F.when(label, text).alias("label"), F.when(label, "").otherwise(text).alias("marks"))

    got = F.transform(events, split)
    first = lambda f: F.get(F.filter(F.transform(got, lambda s: s[f]), lambda x: x.isNotNull()), F.lit(0))
    return F.struct(
        F.when(F.coalesce(tempo, F.lit(0)) != 0, tempo).otherwise(F.coalesce(first("bpm"), F.lit(0))).alias("tempo_bpm"),
        F.when(F.coalesce(rehearsal, F.lit("")) != "", rehearsal).otherwise(F.coalesce(first("label"), F.lit(""))).alias("rehearsal"),
        F.transform(got, lambda s: s["marks"]).alias("marks"))


def _plain(pattern: str) -> str:
    return re.sub(r"^\(\?i\)", "(?i:", pattern) + ")"


def mark_set_check(marks: Column, allowed: list[str]) -> Column:
    """Sorted marks that are not allowed, separated by ', '."""
    words = F.array_distinct(F.filter(F.split(marks, r"\s+"), lambda w: w != ""))
    return F.array_join(F.array_sort(F.array_except(words, F.array(*[F.lit(a) for a in allowed]))), ", ")


def mode_routing(projects: DataFrame, lines: DataFrame, keys, ai: Column, view: str) -> DataFrame:
    """ai, manual (has lines, all captured by hand) or automatic."""
    v = lines.groupBy(*keys).agg(F.bool_and(F.col(view) == 0).alias("_hand"))
    out = projects.join(v, keys, "left")
    return out.select(*keys, F.when(ai, "ai").when(F.coalesce("_hand", F.lit(False)), "manual").otherwise("automatic").alias("mode"))


def whole_rest(bars: DataFrame, events: DataFrame, issues: DataFrame, keys, pickup: str, low_confidence: str) -> DataFrame:
    """Bars that are complete rests: events, no notes, no problem but low confidence.

    ``issues`` are found without the bars' own texts.
    """
    e = events.groupBy(*keys).agg(F.bool_and(F.size("notes") == 0).alias("_silent"))
    i = issues.filter(F.col("issue") != low_confidence).select(*keys).distinct().withColumn("_bad", F.lit(True))
    out = bars.join(e, keys, "left").join(i, keys, "left")
    return out.select(*keys, (~F.col(pickup) & F.coalesce("_silent", F.lit(False)) & F.col("_bad").isNull()).alias("is_rest"))
