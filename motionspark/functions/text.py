"""Text rules of lens names, cameras, searches and durations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What users type for a camera, and what its profiles are called; applied in this order.
SEARCH_ALIASES = (
    ("bmpcc4k", "blackmagic pocket cinema camera 4k"),
    ("bmpcc6k", "blackmagic pocket cinema camera 6k"),
    ("bmpcc", "blackmagic pocket cinema camera"),
    ("gopro5", "hero5 black"), ("gopro 5", "hero5 black"),
    ("gopro6", "hero6 black"), ("gopro 6", "hero6 black"),
    ("gopro7", "hero7 black"), ("gopro 7", "hero7 black"),
    ("gopro8", "hero8 black"), ("gopro 8", "hero8 black"),
    ("gopro9", "hero9 black"), ("gopro 9", "hero9 black"),
    ("gopro10", "hero10 black"), ("gopro 10", "hero10 black"),
    ("gopro11", "hero11 black"), ("gopro 11", "hero11 black"),
    ("gopro12", "hero11 black"), ("gopro 12", "hero11 black"),
    ("gopro13", "hero11 black"), ("gopro 13", "hero11 black"),
    ("session5", "hero5 session"), ("session 5", "hero5 session"),
    ("a73", "a7iii"), ("a74", "a7iv"), ("a75", "a7v"),
    ("a7r3", "a7riii"), ("a7r4", "a7riv"), ("a7r5", "a7rv"),
    ("a7s2", "a7sii"), ("a7s3", "a7siii"),
    (",", " "), (";", " "),
)
# Least width of each label, in this order; 1440p has 1920 by 1440 exactly.
SIZE_LABELS = (("8k", 8000), ("6k", 6000), ("5k", 5000), ("C4k", 4001), ("4k", 3840), ("2.7k", 2700), ("2.5k", 2500), ("2k", 2000), ("1440p", None), ("1080p", 1920), ("720p", 1280), ("480p", 640))
# Of each kind of keyframe the decimals, the unit and the factor with which its value is shown.
KEYFRAME_FORMATS = {
    "Fov": (2, "", 1), "VideoRotation": (1, "°", 1), "ZoomingSpeed": (2, "s", 1), "ZoomingCenterX": (0, "%", 100), "ZoomingCenterY": (0, "%", 100), "MaxZoom": (0, "%", 1),
    "AdditionalRotationX": (2, "°", 1), "AdditionalRotationY": (2, "°", 1), "AdditionalRotationZ": (2, "°", 1),
    "AdditionalTranslationX": (0, "px", 1), "AdditionalTranslationY": (0, "px", 1), "AdditionalTranslationZ": (0, "px", 1),
    "BackgroundMargin": (0, "%", 1), "BackgroundFeather": (0, "%", 1), "LockHorizonAmount": (0, "%", 1), "LockHorizonRoll": (1, "°", 1), "LockHorizonPitch": (1, "°", 1),
    "LensCorrectionStrength": (0, "%", 100), "LightRefractionCoeff": (3, "", 1), "SmoothingParamTimeConstant": (2, "", 1), "SmoothingParamTimeConstant2": (2, "", 1),
    "SmoothingParamSmoothness": (2, "", 1), "SmoothingParamPitch": (2, "", 1), "SmoothingParamRoll": (2, "", 1), "SmoothingParamYaw": (2, "", 1), "VideoSpeed": (1, "%", 100),
}
# Ending of the output by codec, ".mp4" for others.
ENDINGS = {"ProRes": ".mov", "DNxHD": ".mov", "CineForm": ".mov", "EXR Sequence": "_%05d.exr", "PNG Sequence": "_%05d.png"}


PROJECT_ENDING = ".project"  # of this library's project files


def replace_all(c: Column, pairs) -> Column:
    return reduce(lambda s, p: F.replace(s, F.lit(p[0]), F.lit(p[1])), pairs, c)


def search_words(text: Column) -> Column:
    """The words of a search, lower-cased, with aliases replaced in order."""
    return F.filter(F.split(replace_all(F.lower(text), SEARCH_ALIASES), r"[ \t\n\r\f]+"), lambda w: w != "")


def matches_words(words: Column, *fields: Column) -> Column:
    """Every word is in one of the fields; no words match nothing."""
    lowered = [F.lower(F.coalesce(f, F.lit(""))) for f in fields]
    inside = lambda w: reduce(lambda a, b: a | b, [F.contains(f, w) for f in lowered])
    return (F.size(words) > 0) & F.forall(words, inside)


def camera_identifier(brand: Column, model: Column, lens: Column, lens_info: Column, width: Column, height: Column, fps: Column, additional: Column) -> Column:
    """brand-model-lens-info-WxH@fps-additional, lower case, without blanks, doubled dashes and dashes at the ends; empty without brand, model or info.

    fps counts a thousandth; it is 0 for cameras whose sensor is read alike at every rate.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    frames = F.when(brand.isin("RED", "RED RAW"), F.lit(0)).otherwise(F.round(fps * 1000).cast("long"))
    size = F.concat(width.cast("long").cast("string"), F.lit("x"), height.cast("long").cast("string"), F.lit("@"), frames.cast("string"))
    raw = F.concat_ws("-", text(brand), text(model), text(lens), text(lens_info), size, text(additional))
    clean = F.btrim(replace_all(raw, ((" ", ""), ("--", "-"), ("--", "-"))), F.lit("- "))
    known = (text(brand) != "") & (text(model) != "") & (text(lens_info) != "")
    return F.when(known, F.lower(clean)).otherwise("")


def autoload_identifier(identifier: Column) -> Column:
    """Cameras that share the profiles of another one."""
    return replace_all(identifier, (("hero12", "hero11"), ("hero13", "hero11"), ("hero11blackmini", "hero11black")))


def size_label(width: Column, height: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for label, least in SIZE_LABELS:
        out = out.when((width == 1920) & (height == 1440) if least is None else width >= least, label)
    return out.otherwise("")


def duration_ms(text: Column, fps: Column) -> Column:
    """"12ms", "3s" or a number of frames in milliseconds."""
    number = F.regexp_extract(text, r"^\s*(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    return F.when(F.trim(text).endswith("ms"), number).when(F.trim(text).endswith("s"), number * 1000).otherwise(number * 1000 / fps)


def safe_name(name: Column) -> Column:
    """A file name with a dash for slashes, colons, pluses, quotes and blanks."""
    return F.translate(name, "/\\:+'\" ", "-------")


def output_name(url: Column, suffix: Column, codec: Column, other_tracks: Column) -> Column:
    """The input's file name with the suffix and the codec's ending in place of its own."""
    ending = F.coalesce(*(F.when(codec == c, F.lit(e)) for c, e in ENDINGS.items()), F.when(other_tracks, F.lit(".mov")), F.lit(".mp4"))
    return F.concat(F.regexp_replace(file_name(url), r"\.[^.]*$", ""), suffix, ending)


def natural_key(name: Column) -> Column:
    """Sorts digits by value: every run of digits padded to 20."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 20, "0")).otherwise(p)), "")


def file_name(url: Column) -> Column:
    return F.regexp_extract(url, r"([^/\\]*)$", 1)


def folder(url: Column) -> Column:
    return F.regexp_extract(url, r"^(.*[/\\])?[^/\\]*$", 1)


def extension(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"\.([^./\\]+)$", 1))


def keyframe_text(kind: Column, value: Column) -> Column:
    """A keyframe's value as shown."""
    out = F.when(kind == "LockHorizonPitchEnabled", F.when(value != 0, "On").otherwise("Off"))
    for name, (decimals, unit, factor) in KEYFRAME_FORMATS.items():
        out = out.when(kind == name, F.concat(F.format_string(f"%.{decimals}f", value * factor), F.lit(unit)))
    return out


# Shapes of frames by name, the earlier one of equally near ones; how near is near enough; from where on a ratio is written as a number.
ASPECTS = (("1:1", 1, 1), ("3:2", 3, 2), ("2:3", 2, 3), ("4:3", 4, 3), ("3:4", 3, 4), ("8:7", 8, 7), ("7:8", 7, 8), ("16:9", 16, 9), ("9:16", 9, 16))
NEAR_ASPECT, LONG_RATIO = 0.05, 20


def divisor(a: Column, b: Column) -> Column:
    """Greatest common divisor of whole numbers below 2^31."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, 1).otherwise(s["b"])).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(46)), start, step)["a"]


def aspect_ratio(width: Column, height: Column) -> Column:
    """Name of the nearest shape, else the sides' ratio in lowest terms, else as a number; empty without sides."""
    ratio = width / F.when(height != 0, height)
    shapes = F.array(*(F.struct(F.abs(F.lit(a / b) - ratio).alias("far"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (n, a, b) in enumerate(ASPECTS)))
    best, common = F.array_min(shapes), divisor(width, height)
    w, h = (width / common).cast("long"), (height / common).cast("long")
    text = F.when((w >= LONG_RATIO) | (h >= LONG_RATIO), F.concat(F.format_string("%.2f", F.bround(ratio, 2)), F.lit(":1"))).otherwise(F.concat_ws(":", w.cast("string"), h.cast("string")))
    return F.when((width == 0) | (height == 0), "").when(best["far"] < NEAR_ASPECT, best["name"]).otherwise(text)


def profile_name(brand: Column, model: Column, lens: Column, setting: Column, note: Column, width: Column, height: Column, fps: Column) -> Column:
    """File name of a lens profile; the note stands for a missing setting."""
    text = lambda c: F.coalesce(c, F.lit(""))
    chosen = F.when(text(setting) == "", text(note)).otherwise(setting)
    size = F.concat(width.cast("string"), F.lit("x"), height.cast("string"), F.lit("-"), F.format_string("%.2f", fps), F.lit("fps"))
    return F.concat_ws("_", text(brand), text(model), text(lens), chosen, size_label(width, height), F.replace(aspect_ratio(width, height), F.lit(":"), F.lit("by")), size)


def input_kind(url: Column, video: Column) -> Column:
    """"lens" for profiles; projects that name no video are presets, all else is video."""
    project = F.endswith(url, F.lit(PROJECT_ENDING))
    return F.when(F.endswith(url, F.lit(".json")), "lens").when(project & (F.coalesce(video, F.lit("")) == ""), "preset").otherwise("video")
