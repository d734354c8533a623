"""Numbers: formats, arithmetic, units, time value of money, statistics of arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordspark.functions.base import col, finite, let, number, verb


def _fixed(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", F.round(x, digits))


@verb("formatNumber")
def format_number(x, digits: int = 0):
    return F.when(number(x).isNotNull(), _fixed(number(x), digits))


@verb("formatInteger")
def format_integer(x):
    return number(x).try_cast("bigint").cast("string")


@verb("formatCurrency")
def format_currency(x, digits: int = 2):
    return format_number(x, digits)


@verb("formatPercent")
def format_percent(x, digits: int = 0):
    return F.concat(format_number(number(x) * 100, digits), F.lit("%"))


#: Language -> (mark between thousands, decimal mark).
MARKS = {"en": (",", "."), "de": (".", ","), "fr": (" ", ","), "es": (".", ","), "it": (".", ","), "pt": (".", ","), "nl": (".", ","), "ja": (",", "."), "zh": (",", ".")}


@verb("formatLocaleNumber")
def format_locale_number(x, locale: str = "en-US", digits: int = 2):
    thousands, decimal = MARKS.get(locale[:2].lower(), (",", "."))
    return F.translate(F.format_number(number(x), digits), ",.", thousands + decimal)


verb("floor")(lambda x: F.floor(number(x)))
verb("ceil")(lambda x: F.ceil(number(x)))
verb("negate")(lambda x: -number(x))
verb("abs")(lambda x: F.abs(number(x)))
verb("sign")(lambda x: F.signum(number(x)).cast("int"))
verb("add")(lambda a, b: number(a) + number(b))
verb("subtract")(lambda a, b: number(a) - number(b))
verb("multiply")(lambda a, b: number(a) * number(b))
verb("divide")(lambda a, b: F.try_divide(number(a), number(b)))
verb("mod")(lambda a, b: F.try_mod(number(a), number(b)))
verb("ln")(lambda x: finite(F.ln(number(x))))
verb("log10")(lambda x: finite(F.log10(number(x))))
verb("exp")(lambda x: finite(F.exp(number(x))))
verb("pow")(lambda b, e: finite(F.pow(number(b), number(e))))
verb("sqrt")(lambda x: finite(F.sqrt(number(x))))
verb("log")(lambda x, base: finite(F.ln(number(x)) / F.ln(number(base))))


@verb("round")
def round_(x, digits: int = 0):
    """Half goes away from zero."""
    return F.round(number(x), max(0, digits))


@verb("trunc")
def trunc(x):
    return F.when(number(x) < 0, F.ceil(number(x))).otherwise(F.floor(number(x)))


@verb("isFinite")
def is_finite(x):
    return F.coalesce(~F.isnan(number(x)) & (F.abs(number(x)) != float("inf")), F.lit(False))


@verb("isNaN")
def is_nan(x):
    """So is what isn't a number."""
    return number(x).isNull() | F.isnan(number(x))


@verb("safeDivide")
def safe_divide(a, b, otherwise=None):
    return F.when(col(a).isNotNull(), F.coalesce(F.try_divide(number(a), number(b)), col(otherwise).cast("double")))


@verb("minOf")
def min_of(*vs):
    return F.least(*[number(v) for v in vs]) if len(vs) > 1 else number(vs[0])


@verb("maxOf")
def max_of(*vs):
    return F.greatest(*[number(v) for v in vs]) if len(vs) > 1 else number(vs[0])


@verb("clamp")
def clamp(v, low, high):
    v, low, high = number(v), number(low), number(high)
    return F.when(v.isNotNull() & low.isNotNull() & high.isNotNull(), F.least(F.greatest(v, low), high))


@verb("interpolate")
def interpolate(a, b, t, *ignored):
    return number(a) + (number(b) - number(a)) * number(t)


#: How many of a family's base unit each unit is.
UNITS = {
    "mass": {"kg": 1, "g": 0.001, "mg": 0.000001, "lb": 0.453592, "oz": 0.0283495, "ton": 907.185, "tonne": 1000},
    "length": {"m": 1, "km": 1000, "cm": 0.01, "mm": 0.001, "mi": 1609.344, "ft": 0.3048, "in": 0.0254, "yd": 0.9144},
    "volume": {"L": 1, "mL": 0.001, "gal": 3.78541, "qt": 0.946353, "pt": 0.473176, "cup": 0.236588, "floz": 0.0295735},
    "speed": {"mps": 1, "kph": 0.277778, "mph": 0.44704},
    "area": {"sqm": 1, "sqft": 0.092903, "sqkm": 1000000, "sqmi": 2589988.11, "acre": 4046.8564, "hectare": 10000},
    "data": {"B": 1, "KB": 1024, "MB": 1048576, "GB": 1073741824, "TB": 1099511627776},
    "time": {"ms": 0.001, "s": 1, "min": 60, "hr": 3600, "day": 86400},
}
#: Scale and offset that take degrees to Celsius.
DEGREES = {"C": (1.0, 0.0), "F": (5 / 9, -32.0), "K": (1.0, -273.15)}


@verb("convertUnit")
def convert_unit(x, source: str, target: str):
    """null for units that don't go together; six decimals."""
    x = number(x)
    if source == target and (source in DEGREES or any(source in f for f in UNITS.values())):
        return finite(x)
    if source in DEGREES and target in DEGREES:
        (scale, offset), (own, back) = DEGREES[source], DEGREES[target]
        return finite(F.round((x + offset) * scale / own - back, 6))
    for family in UNITS.values():
        if source in family and target in family:
            return finite(F.round(x * family[source] / family[target], 6))
    return F.lit(None).cast("double")


verb("compound")(lambda p, r, n: finite(number(p) * F.pow(1 + number(r), number(n))))
verb("discount")(lambda v, r, n: finite(number(v) / F.pow(1 + number(r), number(n))))
verb("depreciation")(lambda cost, salvage, life: F.try_divide(number(cost) - number(salvage), number(life)))
verb("zscore")(lambda v, mean, sd: F.try_divide(number(v) - number(mean), number(sd)))


@verb("pmt")
def pmt(p, r, n):
    p, r, n = number(p), number(r), number(n)
    growth = F.pow(1 + r, n)
    return F.when(n > 0, F.when(r == 0, p / n).otherwise(finite(p * r * growth / (growth - 1))))


@verb("fv")
def fv(payment, r, n):
    payment, r, n = number(payment), number(r), number(n)
    return F.when(r == 0, payment * n).otherwise(finite(payment * (F.pow(1 + r, n) - 1) / r))


@verb("pv")
def pv(payment, r, n):
    payment, r, n = number(payment), number(r), number(n)
    return F.when(r == 0, payment * n).otherwise(finite(payment * (1 - F.pow(1 + r, -n)) / r))


@verb("nper")
def nper(r, payment, present):
    r, m, p = number(r), number(payment), number(present)
    return F.when(r == 0, F.try_divide(-p, m)).otherwise(finite(F.ln(F.try_divide(m, m + r * p)) / F.ln(1 + r)))


def _newton(start: float, rounds: int, tolerance: float, f, slope) -> Column:
    """Where f is 0, by Newton's steps; null if they don't settle."""
    state = lambda x, done: F.struct(x.alias("x"), done.alias("done"))

    def step(s, _):
        nxt = s["x"] - F.try_divide(f(s["x"]), slope(s["x"]))
        return F.when(s["done"], s).otherwise(state(nxt, F.coalesce(F.abs(nxt - s["x"]) < tolerance, F.lit(False))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), state(F.lit(float(start)), F.lit(False)), step, lambda s: F.when(s["done"], finite(s["x"])))


@verb("rate")
def rate(periods, payment, present, future=0.0):
    n, m, p, v = number(periods), number(payment), number(present), number(future)
    f = lambda r: p * F.pow(1 + r, n) + m * (F.pow(1 + r, n) - 1) / r + v
    slope = lambda r: p * n * F.pow(1 + r, n - 1) + m * (n * F.pow(1 + r, n - 1) * r - F.pow(1 + r, n) + 1) / (r * r)
    return _newton(0.1, 100, 1e-10, f, slope)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def numbers(a) -> Column:
    """The elements that are numbers."""
    return F.filter(F.transform(col(a), lambda x: x.try_cast("double")), lambda x: x.isNotNull())


@verb("npv")
def npv(r, flows):
    r = number(r)
    return _sum(F.transform(numbers(flows), lambda x, i: x / F.pow(1 + r, i)))


@verb("irr")
def irr(flows, guess: float = 0.1):
    flows = numbers(flows)
    value = lambda r: _sum(F.transform(flows, lambda x, i: x / F.pow(1 + r, i)))
    slope = lambda r: _sum(F.transform(flows, lambda x, i: -i * x / F.pow(1 + r, i + 1)))
    return _newton(guess, 200, 1e-10, value, slope)


@verb("sum")
def total(a):
    return _sum(numbers(a))


@verb("count")
def count(a):
    """Nulls too."""
    return F.size(col(a))


verb("min")(lambda a: F.array_min(numbers(a)))
verb("max")(lambda a: F.array_max(numbers(a)))
verb("first")(lambda a: F.get(col(a), F.lit(0)))
verb("last")(lambda a: F.try_element_at(col(a), F.lit(-1)))


@verb("avg")
def avg(a):
    return let(numbers(a), lambda x: F.try_divide(_sum(x), F.size(x)))


def _squares(x: Column) -> Column:
    return let(_sum(x) / F.size(x), lambda m: _sum(F.transform(x, lambda v: (v - m) * (v - m))))


def _spread(sample: bool, root: bool):
    def f(a):
        least = 2 if sample else 1
        v = let(numbers(a), lambda x: F.when(F.size(x) >= least, _squares(x) / (F.size(x) - int(sample))))
        return F.sqrt(v) if root else v

    return f


verb("variance")(_spread(False, False))
verb("std")(_spread(False, True))
verb("varianceSample")(_spread(True, False))
verb("stdSample")(_spread(True, True))


@verb("quantile")
def quantile(a, q):
    """Linear between the two next."""

    def at(x):
        place = F.least(F.greatest(number(q), F.lit(0.0)), F.lit(1.0)) * (F.size(x) - 1)
        low = F.floor(place).cast("int")
        a, b = F.get(x, low), F.get(x, F.ceil(place).cast("int"))
        return a + (b - a) * (place - low)

    return let(F.array_sort(numbers(a)), at)


@verb("percentile")
def percentile(a, p):
    return quantile(a, number(p) / 100)


@verb("median")
def median(a):
    return quantile(a, 0.5)


@verb("mode")
def mode(a):
    """Of the most frequent, the first."""
    counted = lambda x: F.transform(F.array_distinct(x), lambda v, i: F.struct(F.size(F.filter(x, lambda y: y == v)).alias("n"), (-i).alias("i"), v.alias("v")))
    return let(F.filter(col(a), lambda v: v.isNotNull()), lambda x: F.array_max(counted(x))["v"])


def _pairs(xs, ys, use):
    """use(pairs) for the pairs of numbers, up to the shorter array's end."""
    n = F.least(F.size(col(xs)), F.size(col(ys)))
    pairs = F.arrays_zip(F.slice(col(xs), F.lit(1), n).alias("x"), F.slice(col(ys), F.lit(1), n).alias("y"))
    doubles = F.transform(pairs, lambda p: F.struct(p["x"].try_cast("double").alias("x"), p["y"].try_cast("double").alias("y")))
    return let(F.filter(doubles, lambda p: p["x"].isNotNull() & p["y"].isNotNull()), use)


def _moments(p: Column) -> Column:
    n = F.size(p)
    mean = lambda k: _sum(F.transform(p, lambda v: v[k])) / n
    product = lambda a, b: _sum(F.transform(p, lambda v: (v[a] - mean(a)) * (v[b] - mean(b))))
    return F.struct(n.alias("n"), product("x", "y").alias("xy"), product("x", "x").alias("xx"), product("y", "y").alias("yy"))


@verb("covariance")
def covariance(xs, ys):
    return _pairs(xs, ys, lambda p: F.when(F.size(p) > 0, _moments(p)["xy"] / F.size(p)))


@verb("correlation")
def correlation(xs, ys):
    return _pairs(xs, ys, lambda p: F.when(F.size(p) > 0, F.try_divide(_moments(p)["xy"], F.sqrt(_moments(p)["xx"] * _moments(p)["yy"]))))


@verb("weightedAvg")
def weighted_avg(values, weights):
    return _pairs(values, weights, lambda p: F.try_divide(_sum(F.transform(p, lambda v: v["x"] * v["y"])), _sum(F.transform(p, lambda v: v["y"]))))


@verb("movingAvg")
def moving_avg(a, width: int):
    """Of the last `width` elements, fewer at the start; what isn't a number counts as 0."""
    zeros = F.transform(col(a), lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0)))
    return let(zeros, lambda z: F.transform(z, lambda x, i: let(F.slice(z, F.greatest(i - (width - 1), F.lit(0)) + 1, F.least(i + 1, F.lit(width))), lambda w: _sum(w) / F.size(w))))
