"""Column functions over titles, labels, URLs and colours. All stay in the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapsed(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(_c(c), r"\s+", " "))


def lookup_key(c: str | Column) -> Column:
    """Lower case, marks as blanks, blanks collapsed: for prose lookups."""
    return collapsed(F.regexp_replace(F.lower(_c(c)), r"[^a-z0-9]+", " "))


def mention_key(c: str | Column) -> Column:
    """Lower case, apostrophes dropped, other marks but hyphens as blanks: for mentions in text."""
    return collapsed(F.regexp_replace(F.regexp_replace(F.lower(_c(c)), "'", ""), r"[^a-z0-9-]+", " "))


def label_key(c: str | Column, suffixes: tuple[str, ...] = ("music", "genre")) -> Column:
    """Lower case, a parenthesis at the end and the given last words dropped: for near-duplicate labels."""
    out = F.regexp_replace(F.lower(_c(c)), r"\s*\([^)]*\)\s*$", "")
    out = collapsed(F.regexp_replace(out, r"[^a-z0-9]+", " "))
    return F.trim(F.regexp_replace(out, rf"\s+(?:{'|'.join(suffixes)})$", ""))


def container_key(c: str | Column) -> Column:
    """label_key without a leading 'music of' or 'the'."""
    return F.regexp_replace(F.regexp_replace(label_key(c), r"^(?:music (?:of|in) )", ""), r"^the ", "")


def compact_key(c: str | Column) -> Column:
    return F.regexp_replace(F.lower(_c(c)), r"[^a-z0-9]+", "")


def slug(c: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(_c(c))), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def node_id(external: str | Column, title: str | Column) -> Column:
    """The external key if there is one, else a slug of the title."""
    return F.coalesce(F.nullif(_c(external), F.lit("")), slug(title))


def stable_key(*parts: str | Column, length: int = 24) -> Column:
    """The first hex digits of the sha1 of the parts joined by NUL; null parts count as empty."""
    return F.substring(F.sha1(F.concat_ws("\x00", *[F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts])), 1, length)


def display_label(c: str | Column) -> Column:
    """Underscores as blanks, a parenthesis at the end dropped, the first letter upper case."""
    out = collapsed(F.regexp_replace(F.regexp_replace(_c(c), "_", " "), r"\s*\([^)]*\)\s*$", ""))
    return F.concat(F.upper(F.substring(out, 1, 1)), F.substring(out, 2, 1_000_000))


def link_title(c: str | Column) -> Column:
    """A link's target: fragment and namespace prefixes dropped, underscores as blanks, first letter upper case."""
    out = F.regexp_replace(_c(c), r"#.*$", "")
    out = collapsed(F.regexp_replace(F.regexp_replace(out, "_", " "), r"^:+", ""))
    return F.concat(F.upper(F.substring(out, 1, 1)), F.substring(out, 2, 1_000_000))


def skipped_link(c: str | Column, prefixes: tuple[str, ...] = ("file:", "image:", "category:", "help:", "template:", "wikipedia:")) -> Column:
    low = F.lower(_c(c))
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(low, F.lit(p))
    return out


def stable_unit(c: str | Column) -> Column:
    """A number from 0 to 1 that depends on the string only: 32-bit FNV-1a over its characters, divided by 2^32 - 1."""
    chars = F.filter(F.split(_c(c), ""), lambda x: x != "")
    h = F.aggregate(chars, F.lit(2166136261).cast("long"), lambda a, x: (a.bitwiseXOR(F.ascii(x).cast("long")) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long")))
    return h / F.lit(4294967295.0)


def hex_channel(c: str | Column, k: int) -> Column:
    """Channel k (0 to 2) of a colour #rrggbb, from 0 to 1."""
    return F.conv(F.substring(_c(c), 2 + 2 * k, 2), 16, 10).cast("double") / 255.0


def let(value: Column, f) -> Column:
    """f(value) with value worked out once: expressions that use it many times stay small."""
    return F.transform(F.array(value), f)[0]


def _times(matrix, v: Column, n: int = 3) -> Column:
    return F.array(*[sum((F.lit(row[k]) * v[k] for k in range(1, n)), F.lit(row[0]) * v[0]) for row in matrix])


def oklab(c: str | Column) -> Column:
    """[L, a, b] of a colour #rrggbb (the published OKLab matrices)."""
    linear = F.transform(F.array(*[hex_channel(c, k) for k in range(3)]), lambda v: F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4))))
    roots = let(linear, lambda v: F.transform(_times(LMS, v), lambda x: F.pow(x, F.lit(1 / 3))))
    return let(roots, lambda v: _times(LAB, v))


def srgb_hex(lab: Column) -> Column:
    """#rrggbb of an OKLab colour [L, a, b], channels held to 0..1."""
    cubes = let(lab, lambda v: F.transform(F.array(*[v[0] + p * v[1] + q * v[2] for p, q in UNLAB]), lambda x: x * x * x))
    rgb = F.transform(let(cubes, lambda v: _times(UNLMS, v)), lambda v: F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055))
    parts = F.transform(rgb, lambda v: F.lpad(F.hex(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * 255 + 0.5).cast("long")), 2, "0"))
    return F.lower(F.concat(F.lit("#"), F.array_join(parts, "")))


# The OKLab matrices as published.
LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
UNLAB = ((0.3963377774, 0.2158037573), (-0.1055613458, -0.0638541728), (-0.0894841775, -1.2914855480))
UNLMS = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))


def video_id(url: str | Column) -> Column:
    """The 11-character id of a video URL: watch?v=, youtu.be/, embed/, shorts/, live/ or v/."""
    u = _c(url)
    host = F.lower(F.coalesce(F.regexp_extract(u, r"^[a-zA-Z]+://([^/?#]+)", 1), F.lit("")))
    short = F.when(host.isin("youtu.be", "www.youtu.be"), F.regexp_extract(u, r"^[a-zA-Z]+://[^/]+/([A-Za-z0-9_-]{11})(?:[/?#&]|$)", 1))
    own = host.rlike(r"(^|\.)youtube(-nocookie)?\.com$")
    query = F.when(own, F.regexp_extract(u, r"[?&]v=([A-Za-z0-9_-]{11})(?:[&#]|$)", 1))
    path = F.when(own, F.regexp_extract(u, r"^[a-zA-Z]+://[^/]+/(?:embed|shorts|live|v)/([A-Za-z0-9_-]{11})(?:[/?#&]|$)", 1))
    return F.coalesce(F.nullif(short, F.lit("")), F.nullif(query, F.lit("")), F.nullif(path, F.lit("")))


def probe_decision(http_status: str | Column, status: str | Column, playable: str | Column) -> Column:
    """true, false, or null where the probe says nothing sure (rate limits, server errors, no answer)."""
    h, s, p = _c(http_status), F.lower(_c(status)), _c(playable)
    return F.when(h.isNull() | h.isin(408, 425, 429) | (h >= 500), F.lit(None).cast("boolean")).when(h.isin(401, 403, 404, 410), False).when(s == "ok", F.coalesce(p, F.lit(True))).when(s.isin("error", "unplayable", "login_required"), False)


def label_box(c: str | Column, narrow: str = "fijlrtI.,:;'|! ", wide: str = "mwMW@%", height: float = 1.2, padding: float = 0.6) -> tuple[Column, Column]:
    """Width and height of a label in em: .32 a narrow character, .86 a wide one, .56 any other, plus padding."""
    text = _c(c)
    n_narrow = F.length(text) - F.length(F.translate(text, narrow, ""))
    n_wide = F.length(text) - F.length(F.translate(text, wide, ""))
    return n_narrow * 0.32 + n_wide * 0.86 + (F.length(text) - n_narrow - n_wide) * 0.56 + padding, F.lit(height)
