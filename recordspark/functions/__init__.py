"""Value functions on Columns. call(name, ...) finds them by name; VERBS holds them all."""

from recordspark.functions import arrays, codecs, dates, logic, numbers, texts
from recordspark.functions.base import VERBS, call, register, truthy

__all__ = ["VERBS", "arrays", "call", "codecs", "dates", "logic", "numbers", "register", "texts", "truthy"]
