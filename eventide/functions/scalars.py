"""Classifiers, bands and text helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rounding import fixed, to_fixed

#: The weight of each signal in each ranking profile.
PROFILES = {
    "phone_activity": {"object_score": 0.6, "motion_score": 0.2, "camera_quality": 0.2},
    "seat_exchange": {"motion_score": 0.5, "person_proximity": 0.3, "camera_quality": 0.2},
    "neighbor_interaction": {"person_proximity": 0.6, "motion_score": 0.3, "camera_quality": 0.1},
    "camera_disturbance": {"inverse_q_observability": 0.8, "motion_score": 0.2},
    "all_unusual": {"motion_score": 0.4, "object_score": 0.3, "camera_quality": 0.3},
}


def clamp01(x: Column) -> Column:
    """The value cut to 0..1; null and NaN count as 0."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))))


def min_max(x: Column, lo: Column, hi: Column, least: float = 1e-6) -> Column:
    """(x - lo) / (hi - lo) cut to 0..1; 0 where the range is next to nothing."""
    return F.when(hi - lo < least, F.lit(0.0)).otherwise(clamp01((x - lo) / (hi - lo)))


def primary_label(camera_share: Column) -> Column:
    return F.when(camera_share >= 0.5, "camera_motion").when(camera_share < 0.1, "real_motion").otherwise("mixed")


def motion_character(peak_jerk: Column, least: float = 0.6) -> Column:
    """Sudden or gradual; without a jerk score it is gradual."""
    return F.when(F.round(peak_jerk, 4) >= least, "sudden").otherwise("gradual")


def priority(has_phone: Column, peak: Column, persons: Column) -> Column:
    return F.when(has_phone | (peak > 0.7), "high").when((persons > 0) | (peak > 0.4), "medium").otherwise("low")


def event_kind(has_phone: Column, has_paper: Column, persons: Column, camera_share: Column) -> Column:
    return F.when(has_phone, "phone_activity").when(has_paper, "paper_activity").when(persons > 1, "proximity").when(camera_share > 0.5, "camera_motion").otherwise("unusual_motion")


def uncertainty_band(x: Column) -> Column:
    return F.when(x > 0.6, "high").when(x >= 0.3, "medium").when(x.isNull(), "unavailable").otherwise("low")


def dominant(bands: dict[str, Column]) -> Column:
    """``name: band`` of the worst band, the first of equals; ``unavailable`` if none is known."""
    rank = lambda b: F.when(b == "high", 2).when(b == "medium", 1).when(b == "low", 0)
    ranked = F.array(*[F.when(rank(b).isNotNull(), F.struct(rank(b).alias("rank"), F.lit(-i).alias("order"), F.concat(F.lit(f"{k}: "), b).alias("name"))) for i, (k, b) in enumerate(bands.items())])
    return F.coalesce(F.array_max(F.array_compact(ranked))["name"], F.lit("unavailable"))


def grounding(has_box: Column, has_roi: Column, stills: Column, claim: Column) -> Column:
    """How an explanation is supported: full, spatial or temporal; null for a blank claim or no support."""
    spatial, temporal = has_box | has_roi, stills >= 1
    kind = F.when(spatial & temporal, "full").when(spatial, "spatial").when(temporal, "temporal")
    return F.when(F.trim(F.coalesce(claim, F.lit(""))) != "", kind)


def z_text(z: Column) -> Column:
    return F.when(z == 0, "normal").when(F.abs(z) >= 10, "not meaningful").otherwise(F.concat(fixed(to_fixed(z, 1), 1), F.lit(" sigma")))


#: Limits of caption verdicts and of the observability scales are the defaults of the next two.
def caption_verdict(top_label: Column, top_score: Column, margin: Column, innocent: list[str], least: float = 0.45, gap: float = 0.15) -> Column:
    """unjudgeable, contradicted or supported, from the best caption."""
    harmless = F.lit(False)
    for p in innocent:
        harmless = harmless | top_label.startswith(p)
    return F.when((top_score < least) | (margin < gap), "unjudgeable").when(harmless, "contradicted").otherwise("supported")


def observability(shake: Column, blur: Column, jump: Column, shake_max: float = 20.0, blur_min: float = 50.0, jump_max: float = 40.0) -> Column:
    """1 minus the mean of how bad shake, blur and brightness jumps are on fixed scales."""
    bad = [F.least(F.lit(1.0), shake / shake_max), clamp01((blur_min - blur) / blur_min), F.least(F.lit(1.0), jump / jump_max)]
    return 1 - (bad[0] + bad[1] + bad[2]) / 3


def camera_motion(global_flow: Column, local_max: Column, has_rois: Column) -> Column:
    """Whether the whole picture moves rather than something in it."""
    return F.when(global_flow < 0.5, False).when(has_rois, (local_max > 0) & (global_flow >= 0.8 * local_max)).otherwise(global_flow >= 1.0)


def prohibited_label(cls: Column) -> Column:
    """What a reviewer reads for a detected class; other classes as they are."""
    return F.when(cls == "cell phone", "mobile phone").when(cls == "book", "paper/chit").otherwise(cls)


def finding_key(job: Column, track: Column, kind: Column, frame: Column) -> Column:
    return F.concat(job, F.lit("::"), F.concat_ws("|", F.coalesce(track.cast("string"), F.lit("none")), kind, frame.cast("string")))


def camera_key(site: Column, camera: Column) -> Column:
    return F.concat_ws("::", site.cast("string"), camera.cast("string"))


def slug(text: Column) -> Column:
    """Lower-case letters and digits with single dashes, at most 40 characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 40)


def title(text: Column) -> Column:
    return F.initcap(F.replace(text, F.lit("_"), F.lit(" ")))


def clock(seconds: Column) -> Column:
    """m:ss.s"""
    rest = fixed(to_fixed(seconds - F.floor(seconds / 60) * 60, 1), 1)
    return F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad(rest, 4, "0"))


def short_clock(seconds: Column) -> Column:
    """m:ss"""
    return F.format_string("%d:%02d", F.floor(seconds / 60).cast("int"), F.floor(seconds % 60).cast("int"))


def relative_path(path: Column, marker: str) -> Column:
    """The path, with forward slashes, from the first ``marker`` on; paths without it as they are."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    at = F.instr(plain, marker)
    return F.when(at > 0, F.substring(plain, at, F.length(plain))).otherwise(plain)


def lcg(seed: Column) -> Column:
    """The next state of a linear congruential generator with 31 bits, for reproducible fixtures."""
    return (seed * F.lit(1103515245).cast("bigint") + 12345).bitwiseAND(F.lit(0x7FFFFFFF))


def one_of(value: Column, allowed: list[str] | dict[str, object]) -> Column:
    """Whether a name is one of those known, null being none."""
    return F.coalesce(value.isin(*allowed), F.lit(False))


def html_escaped(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def fraction(text: Column) -> Column:
    """``num/den`` as a number; 0 for a zero or missing denominator."""
    num, den = F.split_part(text, F.lit("/"), F.lit(1)).try_cast("double"), F.split_part(text, F.lit("/"), F.lit(2)).try_cast("double")
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def length_prefixed(*parts: Column) -> Column:
    """len:value joined with bars, which no value can forge."""
    return F.concat_ws("|", *[F.concat_ws(":", F.length(p.cast("string")), p.cast("string")) for p in parts])


def abbreviated(digest: Column) -> Column:
    return F.concat(F.substring(digest, 1, 2), F.lit("********"))


def softmax(scores: Column) -> Column:
    """Softmax over an array of numbers."""
    top = F.array_max(scores)
    powers = F.transform(scores, lambda s: F.exp(s - top))
    return F.transform(F.array(powers), lambda p: F.transform(p, lambda x: x / F.aggregate(p, F.lit(0.0), lambda a, b: a + b)))[0]


def stamped_name(ts: Column, name: Column) -> Column:
    """A name with the milliseconds since 1970 in front, which sorts by time."""
    return F.concat(F.unix_millis(ts).cast("string"), F.lit("_"), name)


def day_text(ts: Column) -> Column:
    """Day, month and year as a reader sees them, in English."""
    return F.date_format(ts, "d MMM yyyy, HH:mm")


def collated(text: Column, locale: str = "UNICODE") -> Column:
    """The text with the order and equality of a collation: small letters by capital ones, accents by their letter.

    ``UNICODE`` is the root order of all languages, ``de``, ``fr`` and the like are those of one; with ``_CI`` at its end, case doesn't
    count, with ``_AI`` accents don't.  Sorting, grouping, joins and ranges of the column all go by it.
    """
    return F.collate(text, locale)


def utc_seconds_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
