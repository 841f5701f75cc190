"""Text, date, colour and key functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The colours of each gradient at its ends and middle.
GRADIENTS = {
    "Viridis": [(0.267004, 0.004874, 0.329415), (0.127568, 0.566949, 0.550556), (0.993248, 0.906157, 0.143936)],
    "Plasma": [(0.050383, 0.029803, 0.527975), (0.798216, 0.280197, 0.469538), (0.940015, 0.975158, 0.131326)],
    "Blue-Red": [(0.0, 0.0, 1.0), (1.0, 1.0, 1.0), (1.0, 0.0, 0.0)],
    "Grayscale": [(0.0, 0.0, 0.0), (0.5, 0.5, 0.5), (1.0, 1.0, 1.0)],
}
# Colours of the structure names, and of grains in turn.
STRUCTURE_COLORS = {
    "FCC": (102, 255, 102), "HCP": (255, 102, 102), "BCC": (102, 102, 255), "ICO": (255, 165, 0), "SC": (160, 20, 254),
    "CUBIC_DIAMOND": (19, 160, 254), "CUBIC_DIAMOND_FIRST_NEIGH": (0, 254, 245), "CUBIC_DIAMOND_SECOND_NEIGH": (126, 254, 181),
    "HEX_DIAMOND": (254, 137, 0), "HEX_DIAMOND_FIRST_NEIGH": (254, 220, 0), "HEX_DIAMOND_SECOND_NEIGH": (204, 229, 81),
    "GRAPHENE": (50, 205, 50), "UNKNOWN": (128, 128, 128), "OTHER": (242, 242, 242),
}
GRAIN_COLORS = [
    (230, 51, 51), (51, 204, 51), (51, 102, 230), (242, 191, 25), (217, 51, 217), (25, 217, 217),
    (255, 140, 25), (153, 51, 230), (25, 140, 25), (179, 128, 89), (242, 140, 166), (115, 191, 217),
]
HIGHLIGHT, MUTED = (1.0, 0.2, 0.6), (0.8, 0.8, 0.8)
SENSITIVE_KEYS = r"(?i)(password|token|secret|authorization|apikey|api_key)"


def slugify(c: Column) -> Column:
    """Lower case, runs of other characters than letters and digits to one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def escape_pattern(term: str) -> str:
    """A term for use inside a regular expression."""
    return "".join("\\" + ch if ch in r".*+?^${}()|[]\\" else ch for ch in term)


def split_arguments(text: str) -> list[str]:
    """Words of an argument string; quotes of either kind keep spaces and are taken off."""
    out, now, quote, open_word = [], "", "", False
    for ch in text:
        if quote:
            if ch == quote:
                quote = ""
            else:
                now += ch
        elif ch in "'\"":
            quote, open_word = ch, True
        elif ch.isspace():
            if now or open_word:
                out.append(now)
            now, open_word = "", False
        else:
            now += ch
    return out + ([now] if now or open_word else [])


def vector_text(v: Column) -> Column:
    """``[x y z]`` with three decimals."""
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: F.format_string("%.3f", x)), " "), F.lit("]"))


def timestep_of(name: Column) -> Column:
    """The number of ``timestep-<n>`` or ``<n>`` file names; null if there is none."""
    found = F.regexp_extract(name, r"(?:timestep-)?(\d+)", 1)
    return F.when(found != "", found.cast("long"))


def raster_parts(name: Column) -> tuple[Column, Column]:
    """Timestep and model of ``<timestep>_<model>.png``."""
    step = F.regexp_extract(name, r"(\d+)_(.+)\.png", 1)
    return F.when(step != "", step.cast("long")), F.when(step != "", F.regexp_extract(name, r"(\d+)_(.+)\.png", 2))


def client_ip(forwarded: Column, real: Column, connecting: Column, remote: Column) -> Column:
    """First forwarded address, else the proxy headers in order, else the peer."""
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.coalesce(blank(F.split_part(forwarded, F.lit(","), F.lit(1))), blank(real), blank(connecting), remote)


def redact(m: Column) -> Column:
    """A map with the values of sensitive keys replaced, one level deep."""
    return F.transform_values(m, lambda k, v: F.when(k.rlike(SENSITIVE_KEYS), F.lit("[REDACTED]")).otherwise(v))


def week_key(ts: Column) -> Column:
    """Monday 00:00 UTC of the week."""
    return F.date_trunc("week", ts).cast("timestamp")


def percent_change(now: Column, before: Column) -> Column:
    """Rounded half up; from 0 it is 100, or 0 if nothing came."""
    return F.when(before == 0, F.when(now > 0, 100).otherwise(0)).otherwise(F.floor((now - before) * 100.0 / before + 0.5)).cast("long")


def online_minutes(since: Column, until: Column) -> Column:
    return F.ceil((F.unix_micros(until) - F.unix_micros(since)) / 60e6).cast("long")


def server_status(cpu: Column, memory: Column, disk: Column) -> Column:
    critical = (cpu >= 90) | (memory >= 90) | (disk >= 90)
    warning = (cpu >= 75) | (memory >= 75) | (disk >= 85)
    return F.when(critical, "Critical").when(warning, "Warning").otherwise("Healthy")


def gradient(value: Column, low: Column, high: Column, name: str = "Viridis", steps: int = 1024) -> Column:
    """RGB array of a value between two bounds; equal bounds give the first colour, unknown names the default."""
    stops = GRADIENTS.get(name, GRADIENTS["Viridis"])
    t = F.when(high <= low, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low))))
    t = F.floor(t * (steps - 1)) / float(steps - 1) * (len(stops) - 1)
    i = F.least(F.floor(t), F.lit(len(stops) - 2)).cast("int")
    table = F.array(*[F.array(*[F.lit(x) for x in s]) for s in stops])
    return F.transform(F.arrays_zip(F.get(table, i).alias("p"), F.get(table, i + 1).alias("q")), lambda z: z["p"] + (z["q"] - z["p"]) * (t - i))


def _spread(v: Column) -> Column:
    """Ten bits of a number moved three places apart."""
    for shift, mask in ((16, 0x030000FF), (8, 0x0300F00F), (4, 0x030C30C3), (2, 0x09249249)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def morton_code(x: Column, y: Column, z: Column, low: list[Column], high: list[Column]) -> Column:
    """Interleaved 10-bit cell numbers of a point in a box; degenerate axes count as 0."""
    out = F.lit(0).cast("long")
    for k, (v, lo, hi) in enumerate(zip((x, y, z), low, high)):
        cell = F.when(hi > lo, F.least(F.lit(1023), F.greatest(F.lit(0), F.floor((v - lo) / (hi - lo) * 1023.0)))).otherwise(0).cast("long")
        out = out.bitwiseOR(F.shiftleft(_spread(cell), k))
    return out


def dislocation_type(x: Column, y: Column, z: Column, tolerance: float = 1e-6) -> Column:
    """Family of a Burgers vector by its absolute components; the first family that fits counts."""
    s = F.array_sort(F.array(F.abs(x), F.abs(y), F.abs(z)))
    lo, mid, hi = (F.get(s, F.lit(i)) for i in range(3))
    tol = tolerance
    half = (lo > tol) & (F.try_divide(hi - lo, hi) < tol) & (hi > 0.4) & (hi < 0.6)
    level = (F.abs(F.try_divide(lo, hi) - 1) < tol) & (F.abs(F.try_divide(mid, hi) - 1) < tol) & (hi >= 0.8)
    sixth = (hi >= tol) & (F.abs(F.try_divide(hi, mid) - 2) < tol) & (F.abs(F.try_divide(mid, lo) - 1) < tol) & (hi < 0.4)
    return (
        F.when(half, "1/2<111>")
        .when((hi > tol) & (mid <= tol), "<100>")
        .when((hi - mid < tol) & (lo < tol), "<110>")
        .when(level, "<111>")
        .when(sixth, "1/6<112>")
        .otherwise("Other")
    )


def toggle_reaction(reactions: Column, user: Column, emoji: Column) -> Column:
    """``array<struct<emoji, users>>`` after a user's click: taken off everywhere, and added unless it was there."""
    had = F.exists(reactions, lambda r: (r["emoji"] == emoji) & F.array_contains(r["users"], user))
    clean = F.transform(reactions, lambda r: F.struct(r["emoji"].alias("emoji"), F.array_remove(r["users"], user).alias("users")))
    here = F.exists(clean, lambda r: r["emoji"] == emoji)
    added = F.transform(clean, lambda r: F.struct(r["emoji"].alias("emoji"), F.when(r["emoji"] == emoji, F.array_append(r["users"], user)).otherwise(r["users"]).alias("users")))
    fresh = F.array_append(clean, F.struct(emoji.alias("emoji"), F.array(user).alias("users")))
    return F.filter(F.when(had, clean).when(here, added).otherwise(fresh), lambda r: F.size(r["users"]) > 0)
