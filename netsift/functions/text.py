"""Engineering label parsing, normalisation and classification as Column expressions."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes, states and character corrections of the label grammar.
EQUIPMENT_PREFIXES = ("TR", "CB", "DS", "CT", "PT", "VT", "GEN", "GRID", "BC")
FEEDER_PREFIXES = ("FDR",)
BUS_PREFIXES = ("BUS",)
PREFIXES = EQUIPMENT_PREFIXES + FEEDER_PREFIXES + BUS_PREFIXES
SWITCH_WORDS = ("OPEN", "CLOSED", "N/O", "N/C")
MISREAD, MEANT = "OILSB", "01158"
NUMBER = r"(\d+(?:\.\d+)?)"
VOLTAGE = rf"(?i)^\s*{NUMBER}\s*K\s*V\s*$"
CURRENT = rf"(?i)^\s*{NUMBER}\s*A\s*$"
POWER = rf"(?i)^\s*{NUMBER}\s*([KM])\s*VA\s*$"
LABEL = r"^([A-Z]+)-?([A-Z0-9]++(?:-[A-Z0-9]++)*+)$"


def stripped(text: Column) -> Column:
    """White space off both ends, tabs and line ends included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def compact(text: Column) -> Column:
    """Upper case without white space and underscores."""
    return F.regexp_replace(F.upper(text), r"[\s_]+", "")


def _once(value: Column, use) -> Column:
    """use(value) with value computed once a row, however often use names it."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), 0)


def _shape(text: Column) -> Column:
    """What the parsers look at: the text, its number and unit by format, and prefix and suffix of an id.

    The id pattern is tried only behind the cheap prefix test: it backtracks on prose.
    """

    def ids(short: Column) -> Column:
        begins = short.startswith(PREFIXES[0])
        for p in PREFIXES[1:]:
            begins = begins | short.startswith(p)
        return F.when(begins, F.struct(F.regexp_extract(short, LABEL, 1).alias("prefix"), F.regexp_extract(short, LABEL, 2).alias("suffix")))

    numbers = [F.regexp_extract(text, pattern, 1).alias(k) for k, pattern in (("voltage", VOLTAGE), ("current", CURRENT), ("power", POWER))]
    return F.struct(text.alias("raw"), *numbers, F.regexp_extract(text, POWER, 2).alias("unit"), _once(compact(text), ids).alias("id"))


def _measure(x: Column, kind: str) -> Column:
    """'N unit' of a shape that is a measure of a kind, else null."""
    unit = {"voltage": F.lit("kV"), "current": F.lit("A"), "power": F.concat(F.upper(x["unit"]), F.lit("VA"))}[kind]
    return F.when(x[kind] != "", F.concat(x[kind], F.lit(" "), unit))


def _named(x: Column, prefixes: tuple[str, ...]) -> Column:
    """struct(value, ambiguous) of a shape that is an id of one of the prefixes, else null."""
    suffix = x["id"]["suffix"]
    corrected = F.when(suffix.rlike(f"^[{MISREAD}0-9]+$"), F.translate(suffix, MISREAD, MEANT)).otherwise(suffix)
    found = F.struct(F.concat(x["id"]["prefix"], F.lit("-"), corrected).alias("value"), suffix.rlike(f"[{MISREAD}]").alias("ambiguous"))
    return F.when(x["id"]["prefix"].isin(*prefixes), found)


def parse_voltage(text: Column) -> Column:
    """'N kV' of a text that is a voltage and nothing else, else null."""
    return _once(_shape(text), lambda x: _measure(x, "voltage"))


def parse_current(text: Column) -> Column:
    """'N A' of a text that is a current, else null."""
    return _once(_shape(text), lambda x: _measure(x, "current"))


def parse_power(text: Column) -> Column:
    """'N kVA' in capitals of a text that is an apparent power, else null."""
    return _once(_shape(text), lambda x: _measure(x, "power"))


def parse_prefixed(text: Column, prefixes: tuple[str, ...]) -> Column:
    """struct(value, ambiguous) of an id with one of the prefixes, else null."""
    return _once(_shape(text), lambda x: _named(x, prefixes))


def parse_feeder_id(text: Column) -> Column:
    return parse_prefixed(text, FEEDER_PREFIXES)


def parse_bus_id(text: Column) -> Column:
    return parse_prefixed(text, BUS_PREFIXES)


def parse_equipment_id(text: Column) -> Column:
    return parse_prefixed(text, EQUIPMENT_PREFIXES)


def parse_switch_state(text: Column) -> Column:
    """The state word in capitals, else null."""
    word = F.upper(stripped(text))
    return F.when(word.isin(*SWITCH_WORDS), word)


def _normal(value: Column, confidence, review, evidence) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(value.alias("normalized_text"), as_column(confidence).alias("confidence"), as_column(review).alias("requires_review"), as_column(evidence).alias("evidence"))


def _id_normal(kind: str, found: Column) -> Column:
    unsure = found["ambiguous"]
    note = F.when(unsure, F.lit(f"{kind} syntax; ambiguous character candidate")).otherwise(F.lit(f"{kind} syntax"))
    return _normal(found["value"], F.when(unsure, 0.62).otherwise(0.98), unsure, note)


def normalize(text: Column) -> Column:
    """struct(normalized_text, confidence, requires_review, evidence); null for a null text.

    The first parser that accepts the text wins: voltage, current, power, feeder, bus, equipment.
    """

    def parse(x: Column) -> Column:
        chain = F.when(x["raw"].isNull(), F.lit(None))
        for kind in ("voltage", "current", "power"):
            chain = chain.when(x[kind] != "", _normal(_measure(x, kind), 1.0, False, f"{kind} format"))
        for prefixes, kind in ((FEEDER_PREFIXES, "feeder"), (BUS_PREFIXES, "bus"), (EQUIPMENT_PREFIXES, "equipment")):
            chain = chain.when(x["id"]["prefix"].isin(*prefixes), _once(_named(x, prefixes), partial(_id_normal, kind)))
        return chain.otherwise(_normal(x["raw"], 1.0, False, "raw text retained"))

    return _once(_shape(stripped(text)), parse)


def classify(text: Column) -> Column:
    """struct(text_type, confidence, evidence) of a label; unknown with 0.0 where no rule holds."""
    result = lambda kind, confidence, evidence: F.struct(F.lit(kind).alias("text_type"), F.lit(confidence).alias("confidence"), F.lit(evidence).alias("evidence"))

    def chosen(x: Column) -> Column:
        chain = F.when(x["raw"].isNull(), result("unknown", 0.0, "no text"))
        for kind, name, evidence in (("voltage", "voltage", "voltage parser"), ("current", "current_rating", "current parser"), ("power", "power_rating", "power parser")):
            chain = chain.when(x[kind] != "", result(name, 0.99, evidence))
        for prefixes, name, confidence, evidence in ((FEEDER_PREFIXES, "feeder_id", 0.99, "feeder prefix"), (BUS_PREFIXES, "bus_id", 0.99, "bus prefix"), (EQUIPMENT_PREFIXES, "equipment_id", 0.98, "equipment prefix")):
            chain = chain.when(x["id"]["prefix"].isin(*prefixes), result(name, confidence, evidence))
        chain = chain.when(F.upper(stripped(x["raw"])).isin(*SWITCH_WORDS), result("switch_state", 0.99, "switch-state lexicon"))
        return chain.otherwise(result("unknown", 0.0, "no conservative semantic rule"))

    return _once(_shape(text), chosen)


def canonical(text: Column) -> Column:
    """What label comparison compares."""
    return F.upper(normalize(text)["normalized_text"])


def first_kilovolts(rating: Column) -> Column:
    """The first voltage in a rating text, as double; null without one."""
    found = F.regexp_extract(rating, rf"(?i){NUMBER}\s*kV", 1)
    return F.when(found != "", found.cast("double"))


def voltage_part(rating: Column) -> Column:
    """The first part between middle dots that names volts; null without one."""
    return stripped(F.get(F.filter(F.split(rating, "·"), lambda p: F.lower(p).contains("v")), 0))


def rating_components(text: Column) -> Column:
    """array<struct<semantic_type, value>> of every voltage, current and power named in a text."""
    volts = F.transform(F.regexp_extract_all(text, F.lit(rf"(?i)(?<![0-9/]){NUMBER}\s*k\s*v"), F.lit(1)), lambda x: F.struct(F.lit("voltage").alias("semantic_type"), F.upper(F.concat(x, F.lit(" kV"))).alias("value")))
    amps = F.transform(F.regexp_extract_all(text, F.lit(rf"(?i){NUMBER}\s*a\b"), F.lit(1)), lambda x: F.struct(F.lit("current_rating").alias("semantic_type"), F.upper(F.concat(x, F.lit(" A"))).alias("value")))
    power = rf"(?i){NUMBER}\s*([km])\s*va"
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(power), F.lit(1)).alias("n"), F.regexp_extract_all(text, F.lit(power), F.lit(2)).alias("u"))
    va = F.transform(both, lambda x: F.struct(F.lit("power_rating").alias("semantic_type"), F.upper(F.concat(x["n"], F.lit(" "), x["u"], F.lit("VA"))).alias("value")))
    return F.concat(volts, amps, va)


#: Symbol classes that a label of a type, or an id of a prefix, belongs to.
CLASSES_OF_TYPE = {
    "feeder_id": ("feeder_terminal",),
    "bus_id": ("busbar",),
    "power_rating": ("power_transformer",),
    "current_rating": ("circuit_breaker", "feeder_terminal"),
    "voltage": ("power_transformer", "energy_source"),
}
CLASS_OF_PREFIX = {
    "TR-": "power_transformer",
    "CB-": "circuit_breaker",
    "DS-": "disconnector",
    "CT-": "current_transformer",
    "PT-": "potential_transformer",
    "BC-": "bus_coupler",
    "GRID-": "energy_source",
    "LOAD-": "load",
}


def expected_classes(text_type: Column, value: Column) -> Column:
    """array of the symbol classes that a label may name."""
    chain = None
    for kind, classes in CLASSES_OF_TYPE.items():
        one = F.array(*map(F.lit, classes))
        chain = F.when(text_type == kind, one) if chain is None else chain.when(text_type == kind, one)
    by_prefix = F.array_compact(F.array(*[F.when(F.upper(value).startswith(p), F.lit(c)) for p, c in CLASS_OF_PREFIX.items()]))
    return chain.otherwise(by_prefix)


def html_escape(text: Column) -> Column:
    out = text
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def symbol_of_terminal(terminal_id: Column) -> Column:
    """The symbol id within a composed terminal id."""
    return F.split_part(terminal_id, F.lit(":"), F.lit(2))
