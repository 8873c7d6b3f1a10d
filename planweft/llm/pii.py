"""Operator 6: personal data, by candidate generators and boosted trees. DataFrame and SQL functions only.

Base spans (email, ip, card, phone) follow fixed patterns and checks and always
stay. Further generators of high recall propose spans that may overlap them and
each other: numbers in national formats and dates, named secrets, tokens of known
forms and long hexadecimal ones, disguised addresses, streets and logins, devices,
titled names. Boosted trees judge each proposal by features of its format and of
the text before it, and a calibrated threshold selects what is added. Scoring is
one SQL expression per proposal, inside the row: nothing is shuffled.

The trees are trained on made-up sentences (``pii_examples``) whose private items
are known; their number is a parameter, and their features come from the same SQL.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planweft.llm import gbt, pii_examples
from planweft.llm.shared import only, place_of, positional

LOCAL = "[A-Za-z0-9._%+-]"
#: Fixed patterns, in forms that run in linear time and constant stack: a run that
#: cannot match is tried from its beginning only (or from the last match's end), and
#: nothing is given back where giving back cannot help.
BASE = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Proposals. Repetition is possessive or bounded, so each pattern runs in linear time and constant stack.
MORE = {
    "number": r"(?<![0-9A-Za-z.+-])(?:\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[.-][0-9]{4}|[0-9]{3}[.-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3}"
    r"|[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?|[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})(?![0-9A-Za-z])",
    "secret": r"(?i)(?<![A-Za-z0-9])(?:token|secret(?:[_-]?key)?|password|passwd|pwd|(?:api|access|private|signing)[_-]?key|key)\x20?[=:]\x20?[\x22\x27]?[A-Za-z0-9+/_-]{8,}+",
    "token": r"(?<![A-Za-z0-9])(?:AKIA[A-Z2-7]{16}|gh[pousr]_[A-Za-z0-9]{30,}+|sk-[A-Za-z0-9]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"
    r"|[0-9a-fA-F]{32,}+|-----BEGIN\x20[A-Z\x20]{0,20}PRIVATE\x20KEY-----[^-]*+-----END\x20[A-Z\x20]{0,20}PRIVATE\x20KEY-----)(?![A-Za-z0-9])",
    "address": rf"(?i:(?<!{LOCAL})[a-z0-9._%+-]++\x20?[\[(]\x20?at\x20?[\])]\x20?[a-z0-9-]++(?:\x20?(?:\.|[\[(]\x20?dot\x20?[\])])\x20?[a-z0-9-]++)++)"
    r"|(?<![0-9A-Za-z])[0-9]{1,5}\x20(?:[A-Z][a-zß-ÿ]{1,20}\x20){1,3}(?:Street|St\.|Avenue|Ave\.|Road|Rd\.|Lane|Drive|Boulevard|Blvd\.|Square|Way|Court)(?![a-z])"
    r"|(?<![A-Za-z0-9])[a-z][a-z0-9+]{1,15}://[^\s/@:]{1,64}:[^\s/@:]{1,64}@[A-Za-z0-9.-]++",
    "device": r"(?<![0-9A-Za-z:])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6}|(?:[0-9a-fA-F]{2}[:-]){5}[0-9a-fA-F]{2})(?![0-9A-Za-z:])",
    "person": r"(?<![A-Za-z])(?:(?:Mr|Mrs|Ms|Dr|Prof)\.|Herr|Frau|Mme|Madame|Monsieur|Señora?|Sra?\.|[Mm]y\x20name\x20is|[Ii]ch\x20heiße|[Mm]\x27appelle|[Mm]e\x20llamo)\x20[A-ZÀ-Þ][a-zß-ÿ]{1,20}+(?:[\x20-][A-ZÀ-Þ][a-zß-ÿ]{1,20}+)?",
}
#: What a text must hold for any pattern to match; other texts skip the patterns.
ANY = r"[0-9@=\[(:]|Mr\.|Mrs\.|Ms\.|Dr\.|Prof\.|Herr|Frau|Mme|Madame|Monsieur|Señor|Sra?\.|name\x20is|heiße|appelle|llamo|-----BEGIN|gh[pousr]_|sk-|xox|AKIA|eyJ|[a-fA-F]{32}"
#: Words before a proposal that speak for it or against it, by what they name.
CUES = {
    "phone": "phone|tel|call|ring|fax|mobile|cell|contact|whatsapp|number|reach",
    "card": "card|visa|master|amex|credit|debit|pay|charge",
    "person": "ssn|social|tax id|iban|account|passport|transfer",
    "mail": "mail|write|reach|contact|send",
    "birth": "born|birth|dob",
    "secret": "key|secret|auth|token|password|credential",
    "digest": "commit|sha|md5|checksum|digest|etag|hash",
    "decoy": "order|invoice|isbn|part|version|build|serial|ticket|case|ref|item|model|tracking",
}
#: Forms of a proposal.
FORMS = {
    "nine": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$", "date": r"^[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}$", "iban": r"^[A-Z]{2}[0-9]{2}", "known": r"^(?:AKIA|gh[pousr]_|sk-|xox|eyJ|-----)",
    "hex": r"^[0-9a-fA-F]+$", "quoted": r"[\x22\x27]", "login": "://", "disguised": r"[\[(]\x20?(?:at|AT)\x20?[\])]", "bracketed_dot": r"[\[(]\x20?dot\x20?[\])]", "short": r"^[0-9]{3}[.-][0-9]{4}$",
}
COUNTED = {"letters": "A-Za-z", "upper": "A-Z", "spaces": r"\x20", "dashes": "-", "dots": ".", "brackets": r"()\[\]", "colons": ":"}
FEATURES = ("chars", "digits", "luhn", "distinct", "groups", "value_hex", "value_mixed", "value_upper", "leading_plus", *COUNTED, *FORMS, *(f"is_{k}" for k in MORE), *(f"cue_{k}" for k in CUES))


def running(numbers: str, step: str) -> str:
    """Inclusive running values of an array of non-negative numbers, in blocks so that cost stays near linear; ``step`` joins _u and _v."""
    one = step.replace("_u", "coalesce(get(_a, size(_a) - 1), 0L)").replace("_v", "_x")
    block = f"aggregate(slice({numbers}, _b * 256 + 1, 256), cast(array() AS array<bigint>), (_a, _x) -> array_append(_a, {one}))"
    blocks = f"transform(sequence(0, (size({numbers}) - 1) div 256), _b -> {block})"
    next_ = step.replace("_u", "get(_t, size(_t) - 1)").replace("_v", "get(_p, size(_p) - 1)")
    starts = f"aggregate(_all, array(0L), (_t, _p) -> array_append(_t, {next_}))"
    both = step.replace("_u", "_base").replace("_v", "_w")
    joined = f"flatten(zip_with(_all, slice({starts}, 1, size(_all)), (_part, _base) -> transform(_part, _w -> {both})))"
    return f"CASE WHEN size({numbers}) = 0 THEN cast(array() AS array<bigint>) ELSE transform(array({blocks}), _all -> {joined})[0] END"


def running_sums(lengths: str) -> str:
    return running(lengths, "_u + _v")


def luhn(digits: str) -> str:
    at = f"cast(substr({digits}, length({digits}) - _i + 1, 1) AS int)"
    return f"(aggregate(sequence(1, length({digits})), 0L, (_s, _i) -> _s + CASE WHEN _i % 2 = 0 THEN (2 * {at}) div 10 + (2 * {at}) % 10 ELSE {at} END) % 10 = 0)"


def located(df: DataFrame, name: str, pattern: str, text: str) -> DataFrame:
    """``df`` with ``name``: array of (s, e, t, l): every match, its place in code points, itself, and the text before it in small letters."""
    m, g, n, at = (f"{name}_{x}" for x in "mgns")
    quoted = "r'" + pattern + "'"
    found = df.withColumn(m, F.expr(f"regexp_extract_all({text}, {quoted}, 0)")).withColumn(g, F.expr(f"CASE WHEN size({m}) > 0 THEN split({text}, {quoted}, -1) END"))
    steps = f"transform({m}, (x, i) -> cast(char_length(get({g}, i)) + CASE WHEN i > 0 THEN char_length(get({m}, i - 1)) ELSE 0 END AS bigint))"
    found = found.withColumn(n, F.expr(steps)).withColumn(at, F.expr(running_sums(n)))
    whole = f"transform({m}, (x, i) -> named_struct('s', get({at}, i), 'e', get({at}, i) + char_length(x), 't', x, 'l', lower(right(get({g}, i), 40))))"
    return found.withColumn(name, F.expr(whole)).drop(m, g, n, at)


def base_checks() -> dict[str, str]:
    """What a base match must pass, over lambda variable c."""
    digits = "regexp_replace(c.t, '[^0-9]', '')"
    n = f"length({digits})"
    return {
        "email": "true",
        "ip": "forall(split(c.t, '[.]'), p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(ltrim('0', p) AS int), 0) <= 255)",
        "card": f"CASE WHEN {n} BETWEEN 13 AND 19 THEN {luhn(digits)} ELSE false END",
        "phone": f"{n} BETWEEN 9 AND 15",
    }


def features_sql() -> str:
    """Format and context features of a proposal, over lambda variable c; in the order of FEATURES."""
    digits = "regexp_replace(c.t, '[^0-9]', '')"
    value = r"regexp_extract(c.t, r'[=:]\x20?[\x22\x27]?(.*)$', 1)"
    truth = lambda what: f"CASE WHEN {what} THEN 1 ELSE 0 END"
    return "array(" + ", ".join(f"cast({x} AS double)" for x in (
        "length(c.t)", f"length({digits})", truth(f"CASE WHEN length({digits}) BETWEEN 13 AND 19 THEN {luhn(digits)} ELSE false END"), f"size(array_distinct(split({digits}, '')))",
        r"size(split(c.t, r'[\x20.()-]+'))", truth(f"{value} rlike '^[0-9a-fA-F-]{{12,}}$'"), truth(f"{value} rlike '[0-9]' AND {value} rlike '[A-Za-z]'"), truth(f"{value} rlike '[a-z][A-Z]'"),
        truth(r"c.l rlike r'\+[0-9]{0,3}[\x20-]?$'"),
        *(f"length(regexp_replace(c.t, r'[^{chars}]', ''))" for chars in COUNTED.values()),
        *(truth(f"c.t rlike r'{form}'") for form in FORMS.values()),
        *(truth(f"c.kind = '{kind}'") for kind in MORE),
        *(truth(f"c.l rlike r'\\b(?:{words})'") for words in CUES.values()),
    )) + ")"


def proposals(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``proposed``: all proposals, and ``f``, the features of each."""
    for kind, pattern in MORE.items():
        df = located(df, f"more_{kind}", pattern, text)
    names = [f"more_{k}" for k in MORE]
    every = ", ".join(f"transform(more_{k}, c -> named_struct('kind', '{k}', 's', c.s, 'e', c.e, 't', c.t, 'l', c.l))" for k in MORE)
    df = df.withColumn("proposed", F.expr(f"concat({every})")).drop(*names)
    return df.withColumn("proposed", F.expr(f"transform(proposed, c -> named_struct('kind', c.kind, 's', c.s, 'e', c.e, 'f', {features_sql()}))"))


@dataclass
class Model:
    trees: gbt.Boosted
    threshold: float

    def chosen(self) -> str:
        """SQL over lambda variable c: whether a proposal is taken."""
        if np.isinf(self.threshold):
            return "false"
        return f"({self.trees.margin_sql([f'c.f[{i}]' for i in range(len(FEATURES))])}) >= {self.threshold!r}D"


def made_up(spark: SparkSession, forms: list, rows: int, seed: int) -> DataFrame:
    """``id, private, text`` of made-up sentences, which travel as one literal."""
    lines = "\x1e".join(f"{int(private)}{text}" for private, text in pii_examples.sentences(forms, rows, seed))
    split = spark.range(1).select(F.posexplode(F.split(F.lit(lines), "\x1e")).alias("id", "line"))
    return split.select("id", (F.substring("line", 1, 1) == "1").alias("private"), F.expr("substring(line, 2)").alias("text"))


def train(spark: SparkSession, rows: int = 4000) -> Model:
    """Fit the trees on ``rows`` made-up sentences; half of each form set the calibration."""
    found = proposals(made_up(spark, pii_examples.TRAINING, rows, 11), "text").select("id", "private", F.explode("proposed").alias("c")).select("id", "private", "c.s", "c.f")
    # a few proposals for each of ``rows`` sentences
    data = np.array(sorted([float(r["id"] // len(pii_examples.TRAINING)), float(r["private"]), *r["f"]] for r in found.collect()))
    apart, y, x = data[:, 0] % 2 == 1, data[:, 1], data[:, 2:]
    trees = gbt.fit(x[~apart], y[~apart], rounds=40, depth=3, rate=0.3)
    return Model(trees, gbt.isotonic(trees.margin(x[apart]), y[apart]).threshold(0.5))


def find(df: DataFrame, model: Model, text: str) -> DataFrame:
    """``df`` with ``base`` and ``spans``: arrays of (kind, s, e), code points, end exclusive, by kind and then place. Its columns must be ours."""
    df = df.withColumn("searched", F.coalesce(F.col(text).cast("string"), F.lit("")))
    df = df.withColumn("searched", F.when(F.col("searched").rlike(ANY), F.col("searched")).otherwise(""))
    for kind, pattern in BASE.items():
        df = located(df, f"base_{kind}", pattern, "searched")
        df = df.withColumn(f"base_{kind}", F.expr(f"transform(filter(base_{kind}, c -> {base_checks()[kind]}), c -> named_struct('kind', '{kind}', 's', c.s, 'e', c.e))"))
    df = df.withColumn("base", F.concat(*(f"base_{k}" for k in BASE))).drop(*(f"base_{k}" for k in BASE))
    df = proposals(df, "searched")
    more = f"transform(filter(proposed, c -> {model.chosen()}), c -> named_struct('kind', c.kind, 's', c.s, 'e', c.e))"
    found = df.withColumn("spans", F.expr(f"concat(base, {more})"))
    # a generator of one row each: Catalyst would else copy all of the above into every filter that is put on top
    kept = [c for c in df.columns if c not in ("base", "proposed", "searched")]
    return found.select(*kept, F.inline(F.array(F.struct("base", "spans"))))


def listed(spans: str) -> str:
    return f"array_join(transform({spans}, c -> concat(c.kind, ':', c.s, ':', c.e)), ',')"


def personal_data(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans``.

    Spans are ``kind:start:end``, comma-joined, by kind as listed and then by
    place, the base kinds first; ``n_spans`` is their number, added ones included.
    A null text counts as empty and has no spans. Rows are neither merged nor
    dropped, repeated and null ids included; an empty table gives no rows; other
    columns are ignored, whatever their names. Texts of any length are searched whole.
    """
    found = find(only(df, doc_id=id_col, text=text_col), model, "text")
    counts = [F.expr(f"cast(size(filter(base, c -> c.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.expr(f"sha2({listed('base')}, 256)").alias("base_sha256"), F.expr(listed("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


#: Code points of a block in which redaction counts places, so that no place is counted from a long text's start.
BLOCK = 256


def between(a: str, b: str) -> str:
    """The code points a to b (exclusive) of the text whose blocks are ``blocks``."""
    first, last = f"({a}) div {BLOCK}", f"(({b}) - 1) div {BLOCK}"
    head = f"substring(get(blocks, cast({first} AS int)), cast(({a}) % {BLOCK} AS int) + 1)"
    whole = f"array_join(slice(blocks, cast({first} AS int) + 2, cast({last} - {first} AS int) - 1), '')"
    tail = f"substring(get(blocks, cast({last} AS int)), 1, cast((({b}) - 1) % {BLOCK} AS int) + 1)"
    inside = f"substring(get(blocks, cast({first} AS int)), cast(({a}) % {BLOCK} AS int) + 1, cast(({b}) - ({a}) AS int))"
    return f"CASE WHEN ({b}) <= ({a}) THEN '' WHEN {first} = {last} THEN {inside} ELSE concat({head}, {whole}, {tail}) END"


def redact(df: DataFrame, model: Model, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``df`` with every span of its text replaced by its kind in brackets; overlapping spans are one, of the first one's kind.

    Null texts stay null, empty ones empty. No row is merged or dropped and no
    other column is touched, whatever its name and type, except ``length_col``:
    it gets the new text's number of characters. Time and memory are in
    proportion to the text and its spans. An empty table gives no rows.
    """
    rows = positional(df)
    text = rows.columns[place_of(df, text_col)]
    found = find(rows, model, text)
    found = found.withColumn("sorted", F.expr("sort_array(transform(spans, c -> named_struct('s', c.s, 'e', c.e, 'kind', c.kind)))"))
    found = found.withColumn("ends", F.expr("transform(sorted, c -> c.e)")).withColumn("reach", F.expr(running("ends", "greatest(_u, _v)")))
    found = found.withColumn("firsts", F.expr("filter(CASE WHEN size(sorted) > 0 THEN sequence(0, size(sorted) - 1) ELSE cast(array() AS array<int>) END, i -> i = 0 OR get(sorted, i).s >= get(reach, i - 1))"))
    found = found.withColumn("covers", F.expr("transform(firsts, (i, g) -> named_struct('s', get(sorted, i).s, 'e', get(reach, coalesce(get(firsts, g + 1), size(sorted)) - 1), 'kind', get(sorted, i).kind))"))
    found = found.withColumn("blocks", F.expr(f"CASE WHEN size(spans) > 0 THEN regexp_extract_all(cast({text} AS string), r'(?s).{{1,{BLOCK}}}', 0) END"))
    pieces = f"transform(covers, (c, g) -> concat({between('coalesce(get(covers, g - 1).e, 0L)', 'c.s')}, '[', upper(c.kind), ']'))"
    rest = between("element_at(covers, -1).e", "char_length(cast(" + text + " AS string))")
    clean = F.when(F.size("spans") > 0, F.expr(f"concat(array_join({pieces}, ''), {rest})")).otherwise(F.col(text))
    found = found.select(*(c for c in rows.columns if c != text), F.explode(F.array(clean)).alias(text))  # see find
    if length_col is not None:
        length = rows.columns[place_of(df, length_col)]
        found = found.withColumn(length, F.char_length(text).cast(rows.schema[length].dataType))
    return found.select(*rows.columns).toDF(*df.columns)
