"""Texts read with built-in functions: labelled values, tables whose cells stand one below another, Markdown chunks.

Everything here is a column expression or a select: no Python runs on the rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scalars as S

# What names a field in a text, and the shapes of what follows. Patterns are tried in this order.
LABELS = {
    "invoice_number": (r"(?:invoice\s*(?:number|no\.?(?!\w)|#)|inv\s*(?:no\.?(?!\w)|#))\s*[:\-]?\s*([A-Za-z0-9][A-Za-z0-9\-_/]*)",),
    "po_number": (
        r"(?:purchase\s*order\s*(?:number|no\.?(?!\w)|#)|p\.?o\.?\s*(?:number|no\.?(?!\w)|#)|po\s*(?:no\.?(?!\w)|#))\s*[:\-]?\s*([A-Za-z0-9][A-Za-z0-9\-_/]*)",
        r"(?:purchase\s*order|p\.?o\.?)\s*[:\-]?\s*([A-Za-z]{1,8}-\d[A-Za-z0-9\-_/]*)",
    ),
    "grn_number": (
        r"\bgrn\s*(?:number|no\.?(?!\w)|#)\s*[:\-]?\s*([A-Za-z0-9][A-Za-z0-9\-_/]*)",
        r"goods\s*receipt(?:\s*note)?\s+(?:number|no\.?(?!\w)|#)\s*[:\-]?\s*([A-Za-z0-9][A-Za-z0-9\-_/]*)",
        r"goods\s*receipt(?:\s*note)?\s*[:\-]?\s*([A-Za-z]{1,8}-\d[A-Za-z0-9\-_/]*)",
        r"receipt\s*(?:number|no\.?(?!\w)|#)\s*[:\-]?\s*([A-Za-z0-9][A-Za-z0-9\-_/]*)",
    ),
    "vendor_name": (r"(?:vendor|supplier)\s*(?:name)?\s*[:\-]?\s*(.+)$",),
    "invoice_date": (r"(?:invoice\s*date)\s*[:\-]?\s*([0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}|[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4})",),
    "order_date": (r"(?:po\s*date|order\s*date|purchase\s*order\s*date)\s*[:\-]?\s*([0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}|[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4})",),
    "receipt_date": (r"(?:receipt\s*date|received\s*date|grn\s*date)\s*[:\-]?\s*([0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}|[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4})",),
    "currency": (r"currency\s*[:\-]?\s*([A-Za-z]{3})\b",),
    "subtotal": (r"sub\s*total\s*[:\-]?\s*([$€£₹]?\s*[0-9][0-9,]*(?:\.[0-9]+)?)",),
    "tax_amount": (r"(?<![\w])tax(?:\s*amount)?\s*[:\-]?\s*([$€£₹]?\s*[0-9][0-9,]*(?:\.[0-9]+)?)",),
    "total_amount": (r"(?<!sub)(?<![\w])(?:order\s+)?total(?:\s*amount)?\s*[:\-]?\s*([$€£₹]?\s*[0-9][0-9,]*(?:\.[0-9]+)?)",),
}
# What parts two values on one line, and the shape of a value.
EITHER = r"(?i)\s+(?:/|\||\bor\b)\s+"
DATE_SHAPE = r"[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}|[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4}"
ID_SHAPE = r"[A-Za-z][A-Za-z0-9]*-\d[A-Za-z0-9\-_/]*|[A-Za-z0-9][A-Za-z0-9\-_/]*"
# Column heads of tables whose cells stand one below another, and lines that end such a table.
HEADS = {
    "sku": "reference", "sku item": "reference", "description": "description", "particulars": "description",
    "qty": "quantity", "quantity": "quantity", "received": "quantity", "unit": "unit", "uom": "unit",
    "price": "unit_price", "unit price": "unit_price", "rate": "unit_price", "amount": "amount", "line total": "amount",
    "tax": "tax_rate", "tax rate": "tax_rate", "gst": "tax_rate",
}
FOOTER = r"(?i)^(?:sub\s*total|order\s*total|total|tax|received\s*lines|qa\s*note|synthetic)\b"

#: One letter for each kind of column head.
_LETTERS = {"reference": "r", "description": "d", "quantity": "q", "unit": "u", "unit_price": "p", "amount": "a", "tax_rate": "t"}
_FLAGS = "(?iumU)"


#: A field is looked for only in texts that hold one of each of these groups; each of its patterns needs that.
_HINTS = {
    "invoice_number": (("inv",), ("no", "number", "#")), "po_number": (("po", "p.o", "purchase"),), "grn_number": (("grn", "receipt"),), "vendor_name": (("vendor", "supplier"),),
    "invoice_date": (("invoice",), ("date",)), "order_date": (("po", "order"), ("date",)), "receipt_date": (("receipt", "received", "grn"), ("date",)),
    "currency": (("currency",),), "subtotal": (("sub",), ("total",)), "tax_amount": (("tax",),), "total_amount": (("total",),),
}
#: The letters of a head for quantity, with what may stand between them. A text without them has no stacked table.
_QUANTITY_HEAD = "|".join(r"[^a-z0-9/ \r\n]*".join(word) for word in ("qty", "quantity", "received"))


def lowered(text: Column | str) -> Column:
    """Lower case; the letters that a pattern without case takes for i or s are those."""
    own = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.lower(functools.reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), (("\u0131", "i"), ("\u0130", "i"), ("\u017f", "s")), own))


def holds_one(lower: Column, words: tuple[str, ...]) -> Column:
    return functools.reduce(Column.__or__, (F.contains(lower, F.lit(w)) for w in words))


def _stated(text: Column, pattern: str) -> Column:
    """Array of (value, region): what a pattern's group takes, and the line from there on."""
    group = pattern.rindex("([") if "([" in pattern else pattern.rindex("(.")
    regions = F.regexp_extract_all(text, F.lit(f"{_FLAGS}{pattern[:group]}(?=([^\\n]*)){pattern[group:]}"), 1)
    return F.transform(regions, lambda r: F.struct(F.regexp_extract(r, f"{_FLAGS}^{pattern[group:]}", 1).alias("value"), r.alias("region")))


def read_labels(df: DataFrame, text: str) -> DataFrame:
    """df with fields (map of stated values), ambiguous (names of fields for which one line states several) and stated.

    A field's first statement counts that isn't a word for a missing value. stated tells of each field what was read: its
    value (null where there are several), the raw text, and the line from the value on.
    """
    own = df.select("*", F.coalesce(F.col(text), F.lit("")).alias("_text"), lowered(text).alias("_lower"))
    found = []
    for name, patterns in LABELS.items():
        stated = functools.reduce(F.concat, (_stated(F.col("_text"), p) for p in patterns))
        usable = F.filter(stated, lambda s: ~S.is_missing_value(s["value"]) & ~S.is_missing_value(s["region"]))
        hinted = functools.reduce(Column.__and__, (holds_one(F.col("_lower"), words) for words in _HINTS[name]))
        found.append(F.when(hinted, F.get(usable, F.lit(0))).alias(f"_{name}"))
    read = own.select(*df.columns, *found)

    def values_of(name: str) -> Column:
        shape = DATE_SHAPE if name.endswith("date") else ID_SHAPE
        parts = F.transform(F.split(F.trim(F.col(f"_{name}.region")), EITHER), lambda p: F.regexp_extract(p, shape, 0))
        return F.when(F.col(f"_{name}.region").rlike(EITHER), F.array_distinct(F.filter(parts, lambda p: ~S.is_missing_value(p))))

    judged = read.select("*", *(values_of(k).alias(f"_{k}_values") for k in LABELS))
    many = {k: F.coalesce(F.size(f"_{k}_values") > 1, F.lit(False)) for k in LABELS}
    plain = {k: F.when(~many[k], S.normalize_business_value(F.col(f"_{k}.value"))) for k in LABELS}
    values = [F.struct(F.lit(k).alias("key"), plain[k].alias("value")) for k in LABELS]
    stated = [
        F.when(F.col(f"_{k}").isNotNull(), F.struct(F.lit(k).alias("field"), plain[k].alias("value"), F.when(many[k], F.array_join(f"_{k}_values", " / ")).otherwise(F.col(f"_{k}.value")).alias("raw"), F.trim(F.col(f"_{k}.region")).alias("source_text"), many[k].alias("several")))
        for k in LABELS
    ]
    return judged.select(
        *df.columns,
        F.map_from_entries(F.filter(F.array(*values), lambda e: e["value"].isNotNull())).alias("fields"),
        F.array_sort(F.array_compact(F.array(*(F.when(many[k], F.lit(k)) for k in LABELS)))).alias("ambiguous"),
        F.array_compact(F.array(*stated)).alias("stated"),
    )


def stacked_rows(df: DataFrame, text: str) -> DataFrame:
    """df with stacked: rows (description, quantity, unit_price, tax_rate, reference) of the first stacked table.

    Every line becomes a letter, of its head or a dot. The table's heads are the first run of at least three letters
    with a quantity among them; each row takes as many lines as there are heads. Rows end at a footer, or where neither
    quantity nor price is a number.
    """
    cells = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\r\n|\n|\r"), lambda x: F.trim(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))), lambda x: x != "")
    lines = F.when(F.lower(F.col(text)).rlike(_QUANTITY_HEAD), cells)
    letters = F.create_map(*(F.lit(x) for k, v in HEADS.items() for x in (k, _LETTERS[v])))
    plain = lambda x: F.trim(F.regexp_replace(F.replace(F.regexp_replace(F.lower(x), "[^a-z0-9/ ]+", ""), F.lit("/"), F.lit(" ")), " +", " "))
    heads = F.array_join(F.transform("_lines", lambda x: F.coalesce(F.try_element_at(letters, plain(x)), F.lit("."))), "")
    run = F.regexp_extract("_heads", "(?<![a-z])(?=[a-z]{3})[a-z]*q[a-z]*", 0)
    own = df.withColumn("_lines", lines).withColumn("_heads", heads).withColumn("_run", run)
    width, start = F.length("_run"), F.locate("_run", F.col("_heads")) + F.length("_run")
    own = own.withColumn("_start", F.expr("regexp_instr(_heads, '(?<![a-z])(?=[a-z]{3})[a-z]*q[a-z]*')") + width)
    count = F.when(F.col("_run") != "", F.floor((F.size("_lines") - F.col("_start") + 1) / width).cast("int"))
    cell = lambda row, name: F.when(F.locate(_LETTERS[name], F.col("_run")) > 0, F.get(row, width - F.locate(_LETTERS[name], F.reverse("_run"))))
    rows = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice("_lines", F.col("_start") + i * width, width)))
    own = own.withColumn("_rows", rows)
    fits = lambda r: ~F.get(r, F.lit(0)).rlike(FOOTER) & (S.normalize_quantity(cell(r, "quantity")).isNotNull() | S.normalize_money(cell(r, "unit_price")).isNotNull())
    own = own.withColumn("_first_bad", F.array_position(F.transform("_rows", fits), False))
    good = F.when(F.col("_first_bad") > 0, F.slice("_rows", 1, F.col("_first_bad").cast("int") - 1)).otherwise(F.col("_rows"))
    names = ("description", "quantity", "unit_price", "tax_rate", "reference")
    found = F.transform(good, lambda r: F.struct(*(cell(r, n).alias(n) for n in names)))
    return own.select(*df.columns, F.coalesce(found, F.array().cast(f"array<struct<{','.join(f'{n}:string' for n in names)}>>")).alias("stacked"))


SECTION = "struct<section_id:string,section_title:string,blocks:array<string>>"


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def section_id(title: Column) -> Column:
    """The number path that leads a title, else its words joined by dashes (64 characters at most)."""
    number = F.regexp_extract(title, r"^(\d+(?:\.\d+)*)\.?(?:\s+|$)", 1)
    words = F.substring(F.lower(F.regexp_replace(F.regexp_replace(title, "[^a-zA-Z0-9]+", "-"), "^-+|-+$", "")), 1, 64)
    return F.when(number != "", number).otherwise(F.nullif(words, F.lit("")))


def markdown_sections(text: Column | str) -> Column:
    """Array of (section_id, section_title, blocks): the text split before headings, each part split at blank lines.

    What stands before the first heading is the preamble; sections without text go; a text of headings alone is one
    section without title.
    """
    own = F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "\r\n?", "\n")
    parts = F.split(own, r"(?m)(?=^#{1,6}[^\S\n]+[^\n])")
    is_head = lambda p: p.rlike(r"^#{1,6}[^\S\n]+[^\n]")
    title = lambda p: stripped(F.regexp_extract(p, r"^#{1,6}[^\S\n]+([^\n]+)", 1))
    body = lambda p: F.when(is_head(p), F.regexp_replace(p, r"^[^\n]*\n?", "")).otherwise(p)
    tidy = lambda b: stripped(F.regexp_replace(b, r"(?mU)[^\S\n]+$", ""))
    blocks = lambda p: F.filter(F.transform(F.split(body(p), r"(?U)\n(?:[^\S\n]*\n)+"), tidy), lambda b: b != "")
    section = lambda p: F.struct(F.when(is_head(p), section_id(title(p))).otherwise("preamble").alias("section_id"), F.when(is_head(p), title(p)).otherwise("Preamble").alias("section_title"), blocks(p).alias("blocks"))
    found = F.filter(F.transform(parts, section), lambda s: F.size(s["blocks"]) > 0).cast(f"array<{SECTION}>")
    bare = F.struct(F.lit("body").alias("section_id"), F.lit(None).cast("string").alias("section_title"), F.array(stripped(own)).alias("blocks"))
    return F.when(F.size(found) > 0, found).when(stripped(own) != "", F.array(bare).cast(f"array<{SECTION}>")).otherwise(F.array().cast(f"array<{SECTION}>"))


def _pieces(block: Column, most: int) -> Column:
    """A block in pieces of at most `most` characters: the rest if it is short, else up to the last blank that isn't in the first quarter, else in full."""
    rest, blank, full = rf"[\s\S]{{1,{most}}}\z", rf"[\s\S]{{{max(1, most // 4)},{max(1, most - 1)}}}(?= )", rf"[\s\S]{{{most}}}"
    cut = F.regexp_extract_all(block, F.lit(rf"(?U)\s*+({rest}|{blank}|{full})"), 1)
    return F.filter(F.transform(cut, lambda p: F.regexp_replace(p, r"(?U)\s+$", "")), lambda p: p != "")


def markdown_chunks(text: Column | str, most: int = 2000) -> Column:
    """Array of (section_id, section_title, content): a section's pieces in order, as many as fit into `most` characters with blank lines between."""
    if most < 1:
        raise ValueError("most must be at least 1")
    kind = "struct<done:array<string>,held:string>"
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("held")).cast(kind)

    def add(state: Column, piece: Column) -> Column:
        fits = F.length(state["held"]) + 2 + F.length(piece) <= most
        return (
            F.when(state["held"].isNull(), F.struct(state["done"].alias("done"), piece.alias("held")))
            .when(fits, F.struct(state["done"].alias("done"), F.concat_ws("\n\n", state["held"], piece).alias("held")))
            .otherwise(F.struct(F.array_append(state["done"], state["held"]).alias("done"), piece.alias("held")))
            .cast(kind)
        )

    packed = lambda s: F.aggregate(F.flatten(F.transform(s["blocks"], lambda b: _pieces(b, most))), start, add, lambda z: F.array_append(z["done"], z["held"]))
    chunks = lambda s: F.transform(packed(s), lambda c: F.struct(s["section_id"].alias("section_id"), s["section_title"].alias("section_title"), c.alias("content")))
    return F.flatten(F.transform(markdown_sections(text), chunks))
