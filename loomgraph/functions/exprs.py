"""Scalar expressions over columns, all evaluated by Spark."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINK = r"\[([^\]]+)\]\(([^)]+)\)"
HREF = r'href="([^"]+)"'
FEATURES = ["perplexity", "openai", "ragflow", "settings_sync", "power_user"]


def is_public(content: Column, marker: str = "public:: true", head: int = 101) -> Column:
    """Whether the first bytes, without white space of any kind before them, begin with the marker; a character cut in two counts as another."""
    first = F.make_valid_utf8(F.substring(content.cast("binary"), 1, head).cast("string"))
    return F.regexp_replace(first, r"(?U)^\s+", "").startswith(marker)


def stem(name: Column) -> Column:
    """File name without its .md endings, however often they repeat."""
    return F.regexp_replace(name, r"(\.md)+$", "")


def stem_once(name: Column) -> Column:
    """File name without one .md ending."""
    return F.when(name.endswith(".md"), F.substring(name, F.lit(1), F.length(name) - 3)).otherwise(name)


def link_count(content: Column, pattern: str = LINK) -> Column:
    return F.regexp_count(content, F.lit(pattern)).cast("long")


def node_size(file_size: Column) -> Column:
    """5 to 50 by file size, 1000 bytes being one step of five."""
    return F.lit(5.0) + F.least(file_size / F.lit(1000.0), F.lit(5.0)) * F.lit(9.0)


def mass(file_size: Column, least: int = 1) -> Column:
    """0 to 255 by the logarithm of the file size; the wire variant has least = 0."""
    scaled = F.least(F.greatest(F.log10(file_size.cast("double") + 1.0) / 4.0, F.lit(0.1)), F.lit(10.0)) * 25.5
    return F.greatest(F.lit(least), scaled.cast("int"))


def mass_unit(m: Column) -> Column:
    """Mass in the all-pairs force model: 0 counts as one half."""
    return F.when(m == 0, 0.5).otherwise((m + 1.0) / 256.0)


def edge_id(source: Column, target: Column) -> Column:
    return F.concat_ws("-", source.cast("string"), target.cast("string"))


def parsed_id(text: Column) -> Column:
    """The text as an unsigned 32-bit id; 0 where it is none."""
    digits = text.rlike(r"^\+?[0-9]{1,19}$")
    value = F.when(digits, text.try_cast("long"))
    return F.coalesce(F.when(value.between(0, 2**32 - 1), value), F.lit(0).cast("long"))


def client_id(text: Column, index: Column) -> Column:
    """A leading integer of the text in unsigned 32-bit range, else the row's index plus one."""
    value = F.regexp_extract(text, r"^\s*([+-]?\d{1,18})", 1).try_cast("long")
    return F.when(value.between(0, 2**32 - 1), value).otherwise(index + 1)


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def finite_rows(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Rows of which all fields are numbers and finite."""
    return rows.filter(reduce(lambda a, b: a & b, (is_finite(F.col(f)) for f in fields)))


def size_label(size: Column) -> Column:
    return F.concat(F.format_string("%.1f", size / F.lit(1024.0)), F.lit(" KB"))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"\s+", "%20")


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def camel(text: Column) -> Column:
    """snake_case to camelCase: an underscore goes where a small letter from a to z follows."""
    words = F.split(text, "_(?=[a-z])")
    rest = F.transform(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30)))
    return F.concat(F.element_at(words, 1), F.array_join(rest, ""))


def snake(text: Column) -> Column:
    """camelCase or kebab-case to snake_case: an underscore before each capital from A to Z but a leading one."""
    apart = F.regexp_replace(F.replace(text, F.lit("-"), F.lit("_")), "(?s)(?<=.)([A-Z])", "_$1")
    return F.translate(apart, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced_title(text: Column) -> Column:
    """camelCase to a spaced title; xr is written XR."""
    apart = F.trim(F.regexp_replace(text, "([A-Z])", " $1"))
    title = F.concat(F.upper(F.substring(apart, 1, 1)), F.substring(apart, 2, 1 << 30))
    return F.regexp_replace(title, r"(?i)(^|\s)xr(\s|$)", "$1XR$2")


def distance_fade(distance: Column, show: float, fade: float) -> Column:
    """1 up to show, 0 from fade on, linear between; no fading at all for fade 0."""
    if fade == 0:
        return F.lit(1.0)
    return F.when(distance >= fade, 0.0).when(distance <= show, 1.0).otherwise(F.lit(1.0) - (distance - show) / (fade - show))


def features_of(access: dict[str, Column]) -> Column:
    """Names of the features whose predicate holds, in fixed order."""
    names = [F.when(access[f], F.lit(f)) for f in FEATURES if f in access]
    return F.filter(F.array(*names), lambda x: x.isNotNull())


def csv_list(text: Column) -> Column:
    """Comma-separated entries without white space of any kind around them and without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def path_prefixes(path: Column) -> Column:
    """'' and every leading part of a dotted path."""
    parts = F.split(path, r"\.")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.when(n == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, 1, F.greatest(n, F.lit(1))), ".")))


def backoff(attempt: Column, interval: float = 2000.0, factor: float = 1.5) -> Column:
    return F.lit(interval) * F.pow(F.lit(factor), attempt - 1)


def fuzzy_score(pattern: str, text: Column) -> Column:
    """Greedy subsequence score: 1 per letter and a tenth more for each one that follows directly."""
    if not pattern:
        return F.lit(0.0)
    state = F.struct(F.lit(0).alias("at"), F.lit(0).alias("run"), F.lit(0.0).alias("score"))
    letters = F.array(*map(F.lit, pattern))

    def step(s: Column, letter: Column) -> Column:
        done, hit = s["at"] >= len(pattern), F.get(letters, s["at"]) == letter
        return (
            F.when(done, s)
            .when(hit, F.struct((s["at"] + 1).alias("at"), (s["run"] + 1).alias("run"), (s["score"] + 1.0 + s["run"] * 0.1).alias("score")))
            .otherwise(F.struct(s["at"].alias("at"), F.lit(0).alias("run"), s["score"].alias("score")))
        )

    end = F.aggregate(F.split(text, ""), state, step)
    return F.when(end["at"] == len(pattern), end["score"] / float(len(pattern))).otherwise(0.0)


def sphere_point(index: Column, total: Column, radius: float = 3.0) -> dict[str, Column]:
    """Evenly spread points on a sphere: golden-angle turns and equal steps of height."""
    turn = F.lit(2.0 * math.pi) * index / F.lit((1.0 + math.sqrt(5.0)) / 2.0)
    tilt = F.acos(F.lit(1.0) - F.lit(2.0) * (index + 0.5) / total)
    return {"x": radius * F.sin(tilt) * F.cos(turn), "y": radius * F.sin(tilt) * F.sin(turn), "z": radius * F.cos(tilt)}


def wav_header(raw: Column) -> Column:
    """channels, rate and bits of a RIFF/WAVE header of at least 44 bytes, else null."""

    def little(at: int, n: int) -> Column:
        parts = [F.conv(F.hex(F.substring(raw, at + k + 1, 1)), 16, 10).cast("long") * (1 << (8 * k)) for k in range(n)]
        return sum(parts[1:], parts[0])

    good = (F.octet_length(raw) >= 44) & (F.hex(F.substring(raw, 1, 4)) == "52494646") & (F.hex(F.substring(raw, 9, 4)) == "57415645")
    return F.when(good, F.struct(little(22, 2).alias("channels"), little(24, 4).alias("rate"), little(34, 2).alias("bits")))


def is_deflated(raw: Column) -> Column:
    """Whether bytes begin like a zlib stream."""
    return F.hex(F.substring(raw, 1, 2)).isin("7801", "785E", "789C", "78DA")


def or_zero(component: Column) -> Column:
    """A position's component, 0 where it is missing or no number."""
    return F.coalesce(F.nanvl(component, F.lit(0.0)), F.lit(0.0))


def full_path(base: Column, path: Column) -> Column:
    """base and path without outer slashes, decoded, joined and encoded as one form value."""
    plain = lambda c: F.url_decode(F.regexp_replace(c, "^/+|/+$", ""))
    return F.url_encode(F.concat_ws("/", *(F.when(p != "", p) for p in (plain(base), plain(path)))))


#: Log levels in rising order; fixed values.
LEVELS = ["debug", "info", "warn", "error"]


def level_rank(level: Column) -> Column:
    """0 for the lowest level upwards; unknown levels are null."""
    return F.when(F.array_contains(F.array(*map(F.lit, LEVELS)), level), F.array_position(F.array(*map(F.lit, LEVELS)), level) - 1)


def at_least(level: Column, least: str) -> Column:
    """Whether a log entry of this level is shown."""
    return F.coalesce(level_rank(level) >= LEVELS.index(least), F.lit(False))


def rounded(value: Column | str, digits: int) -> Column:
    """A double rounded as DuckDB rounds it: scaled by a power of ten, rounded half away from zero, scaled back.

    F.round rounds the shortest decimal text instead, which differs where scaling turns 0.7965274999999999 into 796527.5.
    """
    scale = F.lit(10.0**digits)
    return F.round((F.col(value) if isinstance(value, str) else value) * scale, 0) / scale


def closeness(distance: Column, threshold: float) -> Column:
    """A gesture's confidence: 1 at distance 0, 0 from the threshold on."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - distance / F.lit(float(threshold))))


def extension(finger: Column, palm: Column) -> Column:
    """How far a finger reaches beyond the palm, 0 to 1; a measure of our own beside the gestures."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), finger - palm))


#: Metres within which finger tips pinch, and the mean distance from the wrist of a fist; fixed values.
PINCH, FIST = 0.025, 0.04


def _far(a: Column, b: Column) -> Column:
    return F.sqrt(sum(((a[c] - b[c]) * (a[c] - b[c]) for c in "xyz"), F.lit(0.0)))


def gestures(tip: dict[str, Column], base: dict[str, Column], wrist: Column) -> dict[str, Column]:
    """pinch, point and grip of a hand: whether each is made, and (with _confidence) how surely; all null without thumb, index finger and wrist.

    tip and base hold joints (x, y, z), null where untracked, of thumb, index, middle, ring and pinky. A point needs all bases but the
    thumb's; a missing tip counts as curled. A grip needs all tips and the thumb's base.
    """
    others = ["middle", "ring", "pinky"]
    tracked = tip["thumb"].isNotNull() & tip["index"].isNotNull() & wrist.isNotNull()
    pinch = _far(tip["thumb"], tip["index"])
    sure = closeness(pinch, PINCH)
    curls = [F.when(tip[f].isNotNull(), _far(tip[f], base[f])).otherwise(0.0) for f in others]
    bases = base["index"].isNotNull() & base["middle"].isNotNull() & base["ring"].isNotNull() & base["pinky"].isNotNull()
    point = bases & (_far(tip["index"], wrist) > 0.08) & (sum(curls[1:], curls[0]) / 3 < 0.04)
    reach = [_far(tip[f], wrist) for f in ["thumb", "index", *others]]
    mean = sum(reach[1:], reach[0]) / 5
    grip = tip["middle"].isNotNull() & tip["ring"].isNotNull() & tip["pinky"].isNotNull() & base["thumb"].isNotNull() & (mean < FIST)
    out = {
        "pinch": (pinch < PINCH) & (sure > 0.7),
        "pinch_confidence": sure,
        "point": point,
        "point_confidence": F.when(point, 0.8).otherwise(0.0),
        "grip": grip,
        "grip_confidence": F.when(grip, closeness(mean, FIST)).otherwise(0.0),
    }
    return {name: F.when(tracked, F.coalesce(c, F.lit(False)) if "_" not in name else c) for name, c in out.items()}


def mean_square_root(values: Column) -> Column:
    """Aggregate: the root of the mean square."""
    return F.sqrt(F.avg(values * values))


def session_or(requested: Column, default: str) -> Column:
    """The session a request names, else the application's."""
    return F.coalesce(requested, F.lit(default))
