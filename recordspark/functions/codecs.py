"""Encodings, digests, JSON, generated values, places on the globe."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from recordspark.functions.base import col, let, number, text, verb

verb("sha1")(lambda s: F.sha1(text(s)))
verb("sha256")(lambda s: F.sha2(text(s), 256))
verb("sha512")(lambda s: F.sha2(text(s), 512))
verb("md5")(lambda s: F.md5(text(s)))
verb("crc32")(lambda s: F.lpad(F.lower(F.hex(F.crc32(text(s)))), 8, "0"))
verb("base64Encode")(lambda s: F.base64(F.encode(text(s), "UTF-8")))
verb("base64Decode")(lambda s: F.decode(F.try_to_binary(text(s), F.lit("base64")), "UTF-8"))
verb("hexEncode")(lambda s: F.lower(F.hex(F.encode(text(s), "UTF-8"))))
verb("hexDecode")(lambda s: F.decode(F.try_to_binary(text(s), F.lit("hex")), "UTF-8"))
verb("urlDecode")(lambda s: F.try_url_decode(F.replace(text(s), F.lit("+"), F.lit("%2B"))))
verb("jsonEncode")(lambda v: F.coalesce(F.regexp_extract(F.to_json(F.struct(col(v).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1), F.lit("null")))


@verb("urlEncode")
def url_encode(s):
    out = F.url_encode(text(s))
    for a, b in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


@verb("jsonDecode")
def json_decode(s, schema: str | None = None):
    """A variant, or a value of the schema."""
    return F.from_json(text(s), schema) if schema else F.try_parse_json(text(s))


@verb("jsonPath")
def json_path(s, path: str):
    path = path.removeprefix("$").removeprefix(".")
    return F.get_json_object(text(s), "$" + ("" if path.startswith("[") or not path else ".") + path)


WRAP = (1 << 32) - 1


def _fold(s, start: int, step):
    """A 32-bit hash of the code points."""
    points = F.transform(F.filter(F.split(text(s), ""), lambda c: c != ""), lambda c: F.unicode_point(c)) if hasattr(F, "unicode_point") else F.transform(F.filter(F.split(text(s), ""), lambda c: c != ""), lambda c: F.ascii(c))
    return F.aggregate(points, F.lit(start).cast("bigint"), lambda h, c: step(h, c.cast("bigint")).bitwiseAND(F.lit(WRAP)))


@verb("uuid")
def uuid(seed=None):
    """Random, or from a seed alone."""
    if seed is None:
        return F.uuid()
    signed = lambda h: F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)
    parts = []
    for start in (5381, 52711):
        h = signed(_fold(seed, start, lambda h, c: (h * 33).bitwiseXOR(c)))
        parts += [F.shiftright(h, 4 * i).bitwiseAND(F.lit(255)) for i in range(8)]
    parts[6] = parts[6].bitwiseAND(F.lit(0x0F)).bitwiseOR(F.lit(0x50))
    parts[8] = parts[8].bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80))
    digits = F.lower(F.concat(*[F.lpad(F.hex(p), 2, "0") for p in parts]))
    return F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


@verb("random")
def random(low=None, high=None, seed=None):
    """In [0, 1), or from low to high; a string as seed (alone, or third) gives the same number always."""
    if isinstance(low, str) and high is None:
        return _from_seed(low)
    if seed is not None:
        return F.floor(number(low) + _from_seed(seed) * (number(high) - number(low) + 1)).cast("bigint")
    return F.rand() if high is None else number(low) + F.rand() * (number(high) - number(low))


def _from_seed(seed):
    """In [0, 1), from 52 bits of a digest."""
    return F.conv(F.substring(F.md5(text(seed)), 1, 13), 16, 10).cast("double") / float(1 << 52)


ALPHABET = string.ascii_letters + string.digits + "_-"


@verb("nanoid")
def nanoid(n: int = 21, *ignored):
    """n letters from 64, of random bytes of two uuids."""
    bits = F.concat(*[F.replace(F.uuid(), F.lit("-"), F.lit("")) for _ in range(-(-n // 14))])
    return let(bits, lambda b: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substring(F.lit(ALPHABET), F.conv(F.substring(b, i * 2 + 1, F.lit(2)), 16, 10).cast("int") % 64 + 1, F.lit(1))), ""))


#: Radius of the earth.
RADIUS = {"km": 6371.0, "mi": 3959.0, "miles": 3959.0}


def _there(lat, lon):
    return number(lat).between(-90, 90) & number(lon).between(-180, 180)


@verb("distance")
def distance(lat1, lon1, lat2, lon2, unit: str = "km"):
    """Along the great circle, by haversines."""
    if unit not in RADIUS:
        raise ValueError(f"unit {unit!r}; known: {', '.join(RADIUS)}")
    a, b = F.radians(number(lat1)), F.radians(number(lat2))
    half = lambda x: F.pow(F.sin(x / 2), F.lit(2.0))
    h = half(b - a) + F.cos(a) * F.cos(b) * half(F.radians(number(lon2) - number(lon1)))
    return F.when(_there(lat1, lon1) & _there(lat2, lon2), 2 * RADIUS[unit] * F.atan2(F.sqrt(h), F.sqrt(1 - h)))


@verb("inBoundingBox")
def in_bounding_box(lat, lon, min_lat, min_lon, max_lat, max_lon):
    return number(lat).between(number(min_lat), number(max_lat)) & number(lon).between(number(min_lon), number(max_lon))


verb("toRadians")(lambda d: F.radians(number(d)))
verb("toDegrees")(lambda r: F.degrees(number(r)))


@verb("bearing")
def bearing(lat1, lon1, lat2, lon2):
    a, b, d = F.radians(number(lat1)), F.radians(number(lat2)), F.radians(number(lon2) - number(lon1))
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))) + 360, F.lit(360.0))


@verb("midpoint")
def midpoint(lat1, lon1, lat2, lon2):
    """[latitude, longitude]"""
    a, b, d = F.radians(number(lat1)), F.radians(number(lat2)), F.radians(number(lon2) - number(lon1))
    x, y = F.cos(b) * F.cos(d), F.cos(b) * F.sin(d)
    lat = F.atan2(F.sin(a) + F.sin(b), F.sqrt(F.pow(F.cos(a) + x, F.lit(2.0)) + y * y))
    return F.array(F.degrees(lat), F.degrees(F.radians(number(lon1)) + F.atan2(y, F.cos(a) + x)))
