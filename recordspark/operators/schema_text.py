"""Schemas as text: reading, writing, imports.

    {$}
    strict = true
    @Address
    city = !""
    @Home : Address & Dated
    {Person}
    name = !"" :(1..40)
    age = ##:(0..150)
    mail = "" :format email
    kind = (one, two)
    home = @Home
    phone = "" :if kind = one
    :invariant age >= 0
    :exactly_one (mail, phone)
    {Person.tags[]}
    :(1..5) :unique

A field's mark gives its type (as in documents: "" # ## #$ #% ? ^, or a type's name, or several with | between); ! makes
it required. A field of a named type has that type's fields. Sections are paths of fields; {$} holds options.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace

from recordspark.operators.validation import Field, Schema

#: Marks of types.
MARKS = {'""': "string", "##": "integer", "#$": "currency", "#%": "percent", "#": "number", "?": "boolean", "^": "binary", "~": "null"}
WORDS = ("string", "boolean", "number", "integer", "currency", "date", "timestamp", "time", "duration", "percent", "binary", "null")
#: Least and most present fields.
PRESENT = {"exactly_one": (1, 1), "at_most_one": (0, 1), "one_of": (1, 1 << 30)}
#: Limits of imports.
DEPTH, FILES = 32, 100

PART = re.compile(
    r"""\s*(?: (?P<required>!) | (?P<flag>[*-]) | (?P<mark>""|\#\#|\#\$|\#%|\#|\?(?!\w)|\^|~) | (?P<bar>\|) | @(?P<reference>[\w.]+)
    | :?\((?P<group>[^)]*)\) | :/(?P<regex>(?:[^/\\]|\\.)*)/ | :pattern\s+"(?P<pattern>(?:[^"\\]|\\.)*)" | :format\s+(?P<format>[\w-]+) | :enum\s*\((?P<enum>[^)]*)\)
    | :(?P<when>if|unless)\s+(?P<field>[\w.]+)\s*(?:(?P<op>>=|<=|!=|=|>|<)\s*(?P<value>.*))? | :(?P<word>\w+)(?:\s+"[^"]*")? | (?P<type>\w+) )""",
    re.VERBOSE,
)


def _number(s: str) -> float | None:
    return float(s) if s.strip() else None


def _value(s: str):
    s = s.strip().strip('"')
    if s in ("true", "false"):
        return s == "true"
    try:
        return float(s)
    except ValueError:
        return s


def field_of(path: str, text: str) -> Field:
    """The field that the text right of = describes."""
    out, kinds, at = Field(path), [], 0
    while at < len(text.rstrip()):
        m = PART.match(text, at)
        if not m:
            raise ValueError(f"{path}: {text[at:]!r}")
        at, g = m.end(), {k: v for k, v in m.groupdict().items() if v is not None}
        if "required" in g:
            out.required = True
        elif "mark" in g:
            kinds.append(MARKS[g["mark"]])
        elif "reference" in g:
            kinds.append("@" + g["reference"])
        elif "group" in g and ".." in g["group"]:
            low, high = g["group"].split("..")
            out.low, out.high = _number(low), _number(high)
        elif "group" in g and "," not in g["group"]:
            out.low = out.high = _number(g["group"])
        elif "group" in g or "enum" in g:
            out.enum = [x.strip().strip('"') for x in g.get("group", g.get("enum")).split(",")]
        elif "regex" in g or "pattern" in g:
            out.pattern = g.get("regex") or g.get("pattern")
        elif "format" in g:
            out.format = g["format"]
        elif "when" in g:
            clause = (g["field"], g.get("op", "="), _value(g.get("value", "true")))
            (out.when if g["when"] == "if" else out.unless).append(clause)
        elif "word" in g:
            out.unique |= g["word"] == "unique"
            out.exclusive |= g["word"] == "exclusive"
            if g["word"] in WORDS:
                kinds.append(g["word"])
        elif "type" in g and g["type"] in WORDS:
            kinds.append(g["type"])
    out.type = "|".join(kinds) or "string"
    return out


def parse_schema(text: str, read: Callable[[str], str] | None = None, _above: tuple[str, ...] = (), _files: list | None = None) -> Schema:
    """The schema that text describes. read: gives the text of an imported file (@import path as name)."""
    schema, section, kind = Schema([]), "", None
    files = _files if _files is not None else []
    for number, raw in enumerate(text.splitlines(), 1):
        line = raw.strip()
        if not line or line.startswith(";"):
            continue
        within = schema if kind is None else schema.types[kind]
        if m := re.fullmatch(r'@import\s+"?([^"\s]+)"?(?:\s+as\s+(\w+))?', line):
            schema = _imported(schema, m[1], m[2], read, _above, files)
        elif m := re.fullmatch(r"\{@(\w+)\}|@(\w+)(?:\s*:\s*(.+))?", line):
            kind, section = m[1] or m[2], ""
            schema.types[kind] = Schema([], parents=[x.strip().lstrip("@") for x in (m[3] or "").split("&") if x.strip()])
        elif m := re.fullmatch(r"\{(.+)\}", line):
            section, kind = m[1].strip(), None
        elif section == "$":
            key, _, value = (x.strip() for x in line.partition("="))
            schema.strict |= key == "strict" and value == "true"
        elif m := re.fullmatch(r":invariant\s+(.+)", line):
            within.invariants.append(_prefixed(m[1], section))
        elif m := re.fullmatch(r":(exactly_one|at_most_one|one_of|of\s*\((\d*)\.\.(\d*)\))\s*\(?([^)]*)\)?", line):
            least, most = PRESENT.get(m[1]) or (int(m[2] or 0), int(m[3] or 1 << 30))
            within.cardinality.append(([_path(section, x.strip()) for x in m[4].split(",")], least, most))
        elif section.endswith("[]") and line.startswith((":", "(")):
            own = field_of(section[:-2], line)
            within.fields.append(Field(section[:-2], min_items=own.low and int(own.low), max_items=own.high and int(own.high), unique=own.unique))
        elif "=" in line:
            name, _, value = (x.strip() for x in line.partition("="))
            own = field_of(_path(section, name), value)
            beside = lambda clauses: [(_path(section, f), op, v) for f, op, v in clauses]
            own.when, own.unless = beside(own.when), beside(own.unless)
            within.fields.append(own)
        else:
            raise ValueError(f"line {number}: {line!r}")
    return schema


def _path(section: str, name: str) -> str:
    return f"{section}.{name}" if section else name


def _prefixed(expression: str, section: str) -> str:
    return re.sub(r"(?<![\w.])[A-Za-z_][\w.]*", lambda m: _path(section, m[0]), expression)


def _imported(schema: Schema, path: str, name: str | None, read, above: tuple[str, ...], files: list) -> Schema:
    if read is None:
        raise ValueError(f"@import {path}: no reader")
    if path in above:
        raise ValueError(f"@import goes in a circle: {' -> '.join([*above, path])}")
    if len(above) >= DEPTH or len(files) >= FILES:
        raise ValueError(f"@import {path}: too deep or too many")
    files.append(path)
    other = parse_schema(read(path), read, (*above, path), files)
    types = {f"{name}.{k}" if name else k: v for k, v in other.types.items()}
    return replace(schema, fields=[*other.fields, *schema.fields] if not name else schema.fields, types={**types, **schema.types})


def flattened(schema: Schema) -> Schema:
    """Without named types: fields of a type are its own and its parents' fields. Types within themselves are an error."""

    def fields_of(kind: str, above: tuple[str, ...]) -> Schema:
        if kind in above:
            raise ValueError(f"V012: type is within itself: {' -> '.join([*above, kind])}")
        if kind not in schema.types:
            raise ValueError(f"V013: type {kind!r} isn't known")
        own = schema.types[kind]
        out = own.extended(*[fields_of(p, (*above, kind)) for p in own.parents])
        return replace(out, fields=[g for f in out.fields for g in spread(f, (*above, kind))])

    def spread(f: Field, above: tuple[str, ...] = ()) -> list[Field]:
        if not f.type.startswith("@") or "|" in f.type:
            return [f]
        inner = fields_of(f.type[1:], above)
        nested = lambda clauses: [(_path(f.path, x), op, v) for x, op, v in clauses]
        return [replace(g, path=_path(f.path, g.path), when=nested(g.when), unless=nested(g.unless), required=g.required and f.required) for g in inner.fields]

    return replace(schema, fields=[g for f in schema.fields for g in spread(f)], types={})


def _shown(x: float) -> str:
    return "" if x is None else str(int(x)) if float(x).is_integer() else str(x)


def field_text(f: Field) -> str:
    marks = {v: k for k, v in MARKS.items()}
    out = ("!" if f.required else "") + " | ".join(x if x.startswith("@") else marks.get(x, x) for x in f.type.split("|"))
    if f.low is not None or f.high is not None:
        out += f" :({_shown(f.low)}..{_shown(f.high)})" + " :exclusive" * f.exclusive
    out += f" :format {f.format}" if f.format else ""
    out += f' :pattern "{f.pattern}"' if f.pattern else ""
    out += f" :enum({', '.join(map(str, f.enum))})" if f.enum else ""
    out += " :unique" * f.unique
    for name, clauses in (("if", f.when), ("unless", f.unless)):
        for field, op, value in clauses[:1]:
            out += f" :{name} {field.rpartition('.')[2]} {op} {str(value).lower() if isinstance(value, bool) else _shown(value) if isinstance(value, float) else value}"
    return out


def schema_text(schema: Schema) -> str:
    """Text that parse_schema() reads as the same schema."""
    lines = ["{$}", "strict = true"] * schema.strict
    for kind, own in schema.types.items():
        lines.append(f"@{kind}" + (f" : {' & '.join(own.parents)}" if own.parents else ""))
        lines += [f"{f.path} = {field_text(f)}" for f in own.fields]
        lines += _object_lines(own, "")
    sections = dict.fromkeys(f.path.rpartition(".")[0] for f in schema.fields if f.min_items is None and f.max_items is None)
    sections |= dict.fromkeys(fields[0].rpartition(".")[0] for fields, _, _ in schema.cardinality)
    inner = [(re.findall(r"[A-Za-z_][\w.]*", x) or [""])[0].rpartition(".")[0] for x in schema.invariants]
    for section in dict.fromkeys([*sections, *inner]):
        lines.append("{" + section + "}")
        lines += [f"{f.path.rpartition('.')[2]} = {field_text(f)}" for f in schema.fields if f.path.rpartition(".")[0] == section and f.min_items is None and f.max_items is None]
        own = Schema([], [x for x, at in zip(schema.invariants, inner, strict=True) if at == section], [c for c in schema.cardinality if c[0][0].rpartition(".")[0] == section])
        lines += _object_lines(own, section)
    for f in schema.fields:
        if f.min_items is not None or f.max_items is not None:
            lines += ["{" + f.path + "[]}", f":({_shown(f.min_items)}..{_shown(f.max_items)})" + " :unique" * f.unique]
    return "\n".join(lines) + "\n"


def _object_lines(schema: Schema, section: str) -> list[str]:
    short = lambda s: s.replace(section + ".", "") if section else s
    lines = [f":invariant {short(x)}" for x in schema.invariants]
    for fields, least, most in schema.cardinality:
        names = ", ".join(short(x) for x in fields)
        lines.append(f":of ({least}..{'' if most == 1 << 30 else most}) ({names})")
    return lines
