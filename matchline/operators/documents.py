"""Document texts to checked candidate records: type, labelled fields, lines, issues, outcome, reviews, promotion."""

from __future__ import annotations

import functools
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import texts as T
from ..sources.stored import written

#: Words that speak for a type, in file names and texts. Fixed values.
FILE_WORDS = {"INVOICE": r"(?i)inv(oice)?", "PO": r"(?i)(purchase[_\-]?order|\bpo\b)", "GRN": r"(?i)(grn|goods[_\-]?receipt)"}
TEXT_WORDS = {"INVOICE": r"(?i)\b(invoice|tax\s*invoice|bill\s*to|amount\s*due)\b", "PO": r"(?i)\b(purchase\s*order|ordered\s*by|ship\s*to)\b", "GRN": r"(?i)\b(goods\s*receipt|goods\s*received|grn|received\s*quantity)\b"}
#: A text without one of its type's words has none of the type's patterns.
TEXT_HINTS = {"INVOICE": ("invoice", "bill", "amount"), "PO": ("purchase", "ordered", "ship"), "GRN": ("goods", "grn", "received")}
#: Heads of text lines, and a line of description, quantity and price. Fixed values.
LINE_HEADER = r"(?i)^(?:line\s*(?:no\.?|#)?|item\s*(?:no\.?|#)?|#|description|qty|quantity|unit\s*price|price|tax|gst)(?:\s*[|\t]|$)"
TEXT_LINE = r"(.+?)\s+(\d+(?:\.\d+)?)\s+(\d+(?:,\d{3})*(?:\.\d+)?)"
#: What each such line holds, found without trying every description.
TWO_NUMBERS = r"\s\d+(?:\.\d+)?\s+\d"
FINANCIAL = ("quantity", "unit_price", "tax_rate", "subtotal", "tax_amount", "total_amount")
ASSIST_CODES = ("OCR_UNAVAILABLE", "UNKNOWN_OR_EMPTY", "MISSING_INVOICE_NUMBER", "MISSING_PO_NUMBER", "MISSING_GRN_NUMBER", "MISSING_VENDOR", "MISSING_LINES", "INVALID_QUANTITY", "INVALID_PRICE")
DATE_OF = {"INVOICE": "invoice_date", "PO": "order_date", "GRN": "receipt_date"}
NUMBER_OF = {"INVOICE": "invoice_number", "PO": "po_number", "GRN": "grn_number"}
_LINE = "struct<line_number:int,description:string,quantity:string,unit_price:string,tax_rate:string,reference:string,method:string,confidence:string>"
_LINE_FIELDS = ("line_number", "description", "quantity", "unit_price", "tax_rate", "reference", "method", "confidence")


def labelled_fields(docs: DataFrame) -> DataFrame:
    """docs(full_text, ...) with fields (map), ambiguous (names) and stacked (rows), read by built-in functions."""
    return T.stacked_rows(T.read_labels(docs, "full_text"), "full_text")


def classify(read: DataFrame) -> DataFrame:
    """detected_type from declared_type, else votes of file name, labels and words; weak or tied votes are UNKNOWN."""
    has = lambda f: F.coalesce(F.try_element_at("fields", F.lit(f)), F.lit("")) != ""
    score = lambda c, n: F.when(c, n).otherwise(0)
    label = {"INVOICE": score(has("invoice_number"), 3), "PO": score(has("po_number") & ~has("invoice_number") & ~has("grn_number"), 2), "GRN": score(has("grn_number"), 3)}
    name, text, lower = F.coalesce("filename", F.lit("")), F.coalesce("full_text", F.lit("")), F.col("_lower")
    says = lambda k: T.holds_one(lower, TEXT_HINTS[k]) & text.rlike(TEXT_WORDS[k])
    votes = F.array(*(F.struct((score(name.rlike(FILE_WORDS[k]), 2) + label[k] + score(says(k), 2)).alias("n"), F.lit(k).alias("kind")) for k in ("INVOICE", "PO", "GRN")))
    declared = F.coalesce(F.col("declared_type") != "UNKNOWN", F.lit(False))
    ranked = F.col("_ranked")  # a column of its own, so that the votes are counted once
    guess = F.when((ranked[0]["n"] < 2) | (ranked[0]["n"] == ranked[1]["n"]), "UNKNOWN").otherwise(ranked[0]["kind"])
    own = read.withColumn("_lower", F.lower(text)).withColumn("_ranked", F.when(~declared, F.sort_array(votes, asc=False)))
    return own.withColumn("detected_type", S.fenced(F.when(declared, F.col("declared_type")).otherwise(guess))).drop("_lower", "_ranked")


def _find(names: tuple[str, ...]) -> Column:
    """Place of the first head that contains one of the names."""
    hit = lambda h: F.exists(F.array(*(F.lit(n) for n in names)), lambda n: F.contains(h, n))
    return F.array_position(F.transform("_t.headers", lambda h: hit(F.lower(F.trim(h)))), True)


def _line(**values: Column) -> Column:
    return F.struct(*(values.get(f, F.lit(None).cast("int" if f == "line_number" else "string")).cast("int" if f == "line_number" else "string").alias(f) for f in _LINE_FIELDS))


def table_lines(docs: DataFrame) -> DataFrame:
    """D3: docs(doc_id, tables array of (headers, rows)) -> doc_id and table_lines; rows without quantity and price go."""
    own = docs.select("doc_id", F.posexplode("tables").alias("_p", "_t"))
    at = {"quantity": ("qty", "quantity", "received"), "unit_price": ("unit price", "price", "rate"), "tax_rate": ("tax", "gst"), "description": ("description", "item", "particulars")}
    own = own.select("doc_id", "_p", "_t", *(_find(n).cast("int").alias(f"_{k}") for k, n in at.items())).where("_quantity > 0 OR _unit_price > 0")
    rows = own.select("*", F.posexplode("_t.rows").alias("_n", "_r"))
    cell = {k: F.when(F.col(f"_{k}") > 0, F.get("_r", F.col(f"_{k}") - 1)) for k in at}
    rows = rows.where(S.normalize_quantity(cell["quantity"]).isNotNull() | S.normalize_money(cell["unit_price"]).isNotNull())
    line = _line(line_number=F.col("_n") + 1, method=F.lit("table_column"), confidence=F.lit("HIGH"), **cell)
    return rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_n", line.alias("l")))), lambda x: x["l"]).alias("table_lines"))


def stacked_lines() -> Column:
    """Lines of the rows found in stacked columns."""
    names = ("description", "quantity", "unit_price", "tax_rate", "reference")
    return F.transform("stacked", lambda r, i: _line(line_number=i + 1, method=F.lit("stacked_columns"), confidence=F.lit("MEDIUM"), **{k: r[k] for k in names}))


def text_lines() -> Column:
    """`description quantity price` on one text line; the line's number is its place in the text."""
    lines = F.transform(F.split(F.coalesce("full_text", F.lit("")), r"\r\n|\n|\r"), lambda x, i: F.struct(x.alias("x"), (i + 1).alias("i")))
    numbered = F.filter(lines, lambda s: s["x"].rlike(TWO_NUMBERS))  # stripped or not
    bare = F.transform(numbered, lambda s: F.struct(T.stripped(s["x"]).alias("x"), s["i"].alias("i")))
    hits = F.filter(bare, lambda s: ~s["x"].rlike(LINE_HEADER) & s["x"].rlike(TEXT_LINE))
    part = lambda s, k: F.regexp_extract(s["x"], TEXT_LINE, k)
    return F.transform(hits, lambda s: _line(line_number=s["i"], description=part(s, 1), quantity=part(s, 2), unit_price=part(s, 3), method=F.lit("line_regex"), confidence=F.lit("MEDIUM")))


def build_candidates(classified: DataFrame) -> DataFrame:
    """Lines from tables, else stacked columns, else text lines, else (receipts) one labelled quantity; typed header values."""
    docs = classified
    if "tables" in docs.columns:
        docs = docs.join(table_lines(docs), "doc_id", "left")
    else:
        docs = docs.withColumn("table_lines", F.lit(None).cast(f"array<{_LINE}>"))
    labelled = F.regexp_extract(F.coalesce("full_text", F.lit("")), r"(?i)(?:qty|quantity|received)\s*[:\-]?\s*(\d+(?:\.\d+)?)", 1)
    single = F.when((F.col("detected_type") == "GRN") & (labelled != ""), F.array(_line(line_number=F.lit(1), quantity=labelled, method=F.lit("label_regex"), confidence=F.lit("MEDIUM"))))
    some = lambda c: F.when(F.size(c) > 0, c)
    docs = docs.withColumns({"_stacked": stacked_lines(), "_text": text_lines()})
    lines = F.coalesce(some(F.col("table_lines")), some(F.col("_stacked")), some(F.col("_text")), single, F.array().cast(f"array<{_LINE}>"))
    field = lambda k: F.try_element_at("fields", F.lit(k))
    day = None
    for kind, k in DATE_OF.items():
        day = F.when(F.col("detected_type") == kind, field(k)) if day is None else day.when(F.col("detected_type") == kind, field(k))
    typed = F.transform(lines, lambda x: F.struct(x["line_number"].alias("line_number"), S.normalize_identifier(x["description"]).alias("description"), S.normalize_quantity(x["quantity"]).alias("quantity"), S.normalize_money(x["unit_price"]).alias("unit_price"), S.normalize_percentage(x["tax_rate"]).alias("tax_rate"), x["reference"].alias("reference"), x["method"].alias("method"), x["confidence"].alias("confidence")))
    out = docs.withColumns(
        {
            **{k: S.normalize_business_value(field(k)) for k in ("invoice_number", "po_number", "grn_number", "vendor_name")},
            "doc_date": S.normalize_date(day),
            "currency": F.when(field("currency").rlike("^[A-Za-z]{3}$"), F.upper(field("currency"))),
            **{k: S.normalize_money(field(k)) for k in ("subtotal", "tax_amount", "total_amount")},
            "lines": S.fenced(typed),
        }
    )
    return out.withColumn("evidence", evidence(lines)).drop("table_lines", "_stacked", "_text", "stacked", "stated")


#: Fields that a document of each kind states. Fixed values.
STATED = {
    "INVOICE": ("invoice_number", "po_number", "vendor_name", "invoice_date", "currency", "subtotal", "tax_amount", "total_amount"),
    "PO": ("po_number", "vendor_name", "order_date", "currency"),
    "GRN": ("grn_number", "po_number", "vendor_name", "receipt_date"),
}


def evidence(lines: Column) -> Column:
    """Of each header value and each line's quantity and price where it comes from and how sure it is.

    Labelled values are HIGH, several on one line LOW and without a value; cells of tables are HIGH, other lines MEDIUM,
    and what isn't a number LOW. source_text is the line from the value on, or the raw text of a cell.
    """
    item = lambda name, value, raw, source, method, sure: F.struct(*(c.cast("string").alias(k) for k, c in zip(("field", "value", "raw_value", "source_text", "method", "confidence"), (name, value, raw, source, method, sure))))
    kind = F.col("detected_type")
    asked = functools.reduce(lambda c, k: c.when(kind == k, F.array(*map(F.lit, STATED[k]))), list(STATED)[1:], F.when(kind == "INVOICE", F.array(*map(F.lit, STATED["INVOICE"]))))
    several = lambda x, a, b: F.when(x["several"], a).otherwise(b)
    head = F.transform(
        F.filter("stated", lambda x: F.coalesce(F.array_contains(asked, x["field"]), F.lit(False))),
        lambda x: item(x["field"], x["value"], x["raw"], x["source_text"], several(x, "ambiguous_values", "label_regex"), several(x, "LOW", "HIGH")),
    )

    def cells(x: Column, i: Column) -> Column:
        out = []
        for name, value in (("quantity", S.normalize_quantity(x["quantity"])), ("unit_price", S.normalize_money(x["unit_price"]))):
            path = F.concat(F.lit("lines["), i.cast("string"), F.lit(f"].{name}"))
            out.append(F.when(F.coalesce(x[name], F.lit("")) != "", item(path, value, x[name], x[name], x["method"], F.when(value.isNull(), "LOW").otherwise(x["confidence"]))))
        return F.array_compact(F.array(*out))

    return F.concat(head, F.flatten(F.transform(lines, cells)))


def validate_candidates(c: DataFrame) -> DataFrame:
    """Issues (code, severity), is_valid and requires_review; ambiguous fields ask for review."""
    kind, issue = F.col("detected_type"), lambda test, code, level="error": F.when(test, F.struct(F.lit(code).alias("code"), F.lit(level).alias("severity")))
    known = kind != "UNKNOWN"
    warned = F.exists(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: w.rlike("OCR unavailable|not installed")) if "warnings" in c.columns else F.lit(False)
    head = [issue(warned, "OCR_UNAVAILABLE", "review"), issue(~known, "UNKNOWN_OR_EMPTY", "review")]
    for k, number, day in (("INVOICE", "MISSING_INVOICE_NUMBER", "MISSING_INVOICE_DATE"), ("PO", "MISSING_PO_NUMBER", "MISSING_PO_DATE"), ("GRN", "MISSING_GRN_NUMBER", "MISSING_RECEIPT_DATE")):
        head += [issue((kind == k) & S.is_missing_value(NUMBER_OF[k]), number), issue((kind == k) & F.col("doc_date").isNull(), day)]
    head += [issue(kind.isin("INVOICE", "PO") & S.is_missing_value("vendor_name"), "MISSING_VENDOR"), issue(known & (F.size("lines") == 0), "MISSING_LINES")]
    per_line = F.flatten(F.transform("lines", lambda x: F.array_compact(F.array(issue(x["quantity"].isNull() | (x["quantity"] <= 0), "INVALID_QUANTITY"), issue(kind.isin("INVOICE", "PO") & (x["unit_price"].isNull() | (x["unit_price"] < 0)), "INVALID_PRICE")))))
    unclear = F.transform("ambiguous", lambda f: F.struct(F.lit("AMBIGUOUS_FIELD").alias("code"), F.lit("review").alias("severity")))
    own = c.withColumn("issues", F.concat(F.array_compact(F.array(*head)), F.when(known, per_line).otherwise(F.array().cast("array<struct<code:string,severity:string>>")), unclear))
    review = F.exists("issues", lambda i: i["severity"] == "review")
    return own.withColumns({"requires_review": review, "is_valid": F.size("issues") == 0})


def outcome(c: DataFrame) -> DataFrame:
    """D8."""
    return c.withColumn("outcome", F.when(F.size("ambiguous") > 0, "REVIEW_REQUIRED").when(F.col("is_valid"), "READY_FOR_RECONCILIATION").when(F.col("requires_review"), "REVIEW_REQUIRED").otherwise("VALIDATION_FAILED"))


def understand(docs: DataFrame) -> DataFrame:
    """D1 to D8 for docs(doc_id, filename, declared_type, full_text[, tables, warnings]), read by labelled_fields or not yet."""
    read = docs if "stacked" in docs.columns else labelled_fields(docs)
    return outcome(validate_candidates(build_candidates(classify(read))))


def route_reviews(understood: DataFrame, tasks: DataFrame) -> DataFrame:
    """A task for each result that needs review and has none yet."""
    codes = F.transform("issues", lambda i: i["code"])
    high = (F.col("detected_type") == "UNKNOWN") | F.arrays_overlap(codes, F.array(F.lit("OCR_UNAVAILABLE"), F.lit("UNKNOWN_OR_EMPTY")))
    reason = F.concat_ws(" ", F.when(F.size("ambiguous") > 0, "Ambiguous fields require review.").otherwise("Extraction requires human review."), F.when(F.col("detected_type") == "UNKNOWN", "Document type is UNKNOWN."), F.when(F.array_contains(codes, "OCR_UNAVAILABLE"), "OCR unavailable."))
    return understood.where("outcome = 'REVIEW_REQUIRED'").join(tasks.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.when(high, "HIGH").otherwise("MEDIUM").alias("priority"), F.lit("PENDING").alias("status"), reason.alias("reason"))


#: Fields that can be corrected, by kind. Fixed values.
TEXT_FIELDS = ("invoice_number", "po_number", "grn_number", "vendor_name", "currency", "description", "reference")
BUSINESS_FIELDS = ("invoice_number", "po_number", "grn_number", "vendor_name")
POSITIVE_FIELDS, AMOUNT_FIELDS = ("quantity",), ("unit_price", "tax_rate", "subtotal", "tax_amount", "total_amount")
HEAD_FIELDS = ("invoice_number", "po_number", "grn_number", "vendor_name", "currency", "subtotal", "tax_amount", "total_amount", "doc_date")
LINE_FIELDS = ("line_number", "description", "quantity", "unit_price", "tax_rate", "reference")


def judge_corrections(candidates: DataFrame, corrections: DataFrame) -> DataFrame:
    """corrections(doc_id, seq, field_path, value) with path (as fields are named here), clean (the value to set) and reason.

    reason is null where the correction holds. A document must have a candidate and the field, a line must exist.
    Quantities are positive, amounts and rates not negative, dates ISO, line numbers 1 or more, texts not empty, currencies
    of three letters. A null value clears its field.
    """
    known = candidates.select(F.col("doc_id"), F.col("detected_type").alias("_type"), F.size("lines").alias("_n"))
    own = corrections.join(known, "doc_id", "left")
    of_line = F.coalesce(F.startswith("field_path", F.lit("lines[")), F.lit(False))
    index = F.when(of_line, F.regexp_extract("field_path", r"^lines\[(\d+)\]\.\w+$", 1)).otherwise("")
    name = F.when(of_line, F.regexp_replace("field_path", r"^lines\[\d+\]\.", "")).otherwise(F.coalesce("field_path", F.lit("")))
    dated = functools.reduce(lambda c, k: c | ((F.col("_type") == k) & (name == DATE_OF[k])), DATE_OF, F.lit(False))
    own = own.withColumns({"_index": F.when(index != "", index.try_cast("int")), "_inside": index != "", "_name": F.when(dated, "doc_date").otherwise(name), "_v": T.stripped(F.col("value"))})
    n, v, inside = F.col("_name"), F.col("_v"), F.col("_inside")
    is_number = n.isin(*POSITIVE_FIELDS, *AMOUNT_FIELDS)
    day = F.coalesce(F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(v, "yyyy-MM-dd")), F.when(v.rlike(r"^\d{8}$"), F.try_to_date(v, "yyyyMMdd")))
    # Each kind of value is read once, and only for its own fields.
    own = own.withColumns(
        {
            "_number": F.when(is_number & v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), v).try_cast(S.NUMBER),
            "_whole": F.when((n == "line_number") & v.rlike(r"^[+-]?\d+$"), v).try_cast("int"),
            "_day": F.when(n == "doc_date", day),
            "_said": F.when(n.isin(*BUSINESS_FIELDS), S.normalize_business_value(v)).otherwise(v),
        }
    )
    number, whole, day = F.col("_number"), F.col("_whole"), F.col("_day")
    own = own.withColumn("clean", F.when(is_number, number.cast("string")).when(n == "line_number", whole.cast("string")).when(n == "doc_date", day.cast("string")).otherwise(F.col("_said")))
    empty = F.coalesce("clean", F.lit("")) == ""
    reason = (
        F.when(F.col("_type").isNull() | (F.col("_type") == "UNKNOWN"), "no candidate")
        .when(inside & ~n.isin(*LINE_FIELDS) | ~inside & ~n.isin(*HEAD_FIELDS), "unknown field")
        .when(inside & (F.col("_index").isNull() | (F.col("_index") >= F.col("_n"))), "no such line")
        .when(F.col("value").isNull(), None)
        .when(is_number & number.isNull(), "not a number").when(n.isin(*POSITIVE_FIELDS) & (number <= 0), "not positive").when(n.isin(*AMOUNT_FIELDS) & (number < 0), "negative")
        .when((n == "doc_date") & day.isNull(), "not an ISO date").when((n == "line_number") & (whole.isNull() | (whole < 1)), "not a line number")
        .when(n.isin(*TEXT_FIELDS) & empty, "empty").when((n == "currency") & (F.length(v) != 3), "not three letters")
    )
    path = F.when(inside, F.concat(F.lit("lines["), F.col("_index").cast("string"), F.lit("]."), n)).otherwise(n)
    judged = own.withColumns({"path": path, "reason": reason})
    return judged.select(*corrections.columns, "path", "clean", "reason")


def apply_corrections(candidates: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """corrections(doc_id, seq, field_path, value) on header fields and `lines[i].field`; the last that holds per path counts.

    Returns the corrected candidates, to be validated again, and the rejected corrections with a reason.
    """
    judged = written(judge_corrections(candidates, corrections))  # read for what holds and for what doesn't
    last = judged.where("reason IS NULL").groupBy("doc_id", "path").agg(F.max_by(F.struct("clean"), F.col("seq")).alias("v"))
    index = F.when(F.startswith("path", F.lit("lines[")), F.regexp_extract("path", r"\d+", 0).cast("int"))
    maps = last.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("path"), F.col("v.clean")))).alias("_fix"), F.collect_set(index).alias("_touched"))  # one entry per corrected path
    joined = candidates.join(maps, "doc_id", "left").withColumn("_fix", F.coalesce("_fix", F.create_map().cast("map<string,string>")))
    kinds = {f.name: f.dataType for f in candidates.schema["lines"].dataType.elementType} | {f.name: f.dataType for f in candidates.schema}

    def fixed(key: Column, old: Column, name: str) -> Column:
        return F.when(F.map_contains_key("_fix", key), F.try_element_at("_fix", key).cast(kinds[name])).otherwise(old)

    def line(x: Column, i: Column) -> Column:
        new = x
        for name in LINE_FIELDS:
            new = new.withField(name, fixed(F.concat(F.lit("lines["), i.cast("string"), F.lit(f"].{name}")), x[name], name))
        return F.when(F.array_contains("_touched", i), new).otherwise(x)

    out = joined.withColumns({**{k: fixed(F.lit(k), F.col(k), k) for k in HEAD_FIELDS}, "lines": F.transform("lines", line)})
    return out.drop("_fix", "_touched"), judged.where("reason IS NOT NULL").drop("path", "clean")


def promotable(understood: DataFrame, tasks: DataFrame) -> DataFrame:
    """Results whose review is APPROVED or CORRECTED, without failure, ambiguity or hard error."""
    hard = F.exists("issues", lambda i: i["severity"] == "error")
    own = understood.where((F.col("outcome") != "VALIDATION_FAILED") & (F.size("ambiguous") == 0) & ~hard)
    return own.join(tasks.where(F.col("status").isin("APPROVED", "CORRECTED")).select("doc_id"), "doc_id", "left_semi")


class Promotion(NamedTuple):
    """What promotion makes: headers and lines to add, vendors to add, records that exist already, and what it refuses."""

    heads: DataFrame
    lines: DataFrame
    vendors: DataFrame
    reused: DataFrame
    rejected: DataFrame


def promote(candidates: DataFrame, vendors: DataFrame, po: DataFrame, po_line: DataFrame, grn: DataFrame, inv: DataFrame) -> Promotion:
    """Candidates to orders, receipts and invoices with lines.

    A number that exists already is reused, whatever else the document says; of several documents with one new number
    the least doc_id makes the record and the others reuse it (id null). A vendor is the document's link
    (candidates.vendor_id, if there is such a column), else found by name, else made once per name; an order the link
    (purchase_order_id), else found by number among the existing ones. Refused with a reason: no number, no date, no
    vendor (orders, invoices), no order (receipts), no line, a quantity that isn't positive, a negative or missing price
    (orders, invoices). Lines link to the order's line of their number. Defaults: currency USD, amounts 0.
    """
    own = candidates
    for c in ("vendor_id", "purchase_order_id"):
        if c not in own.columns:
            own = own.withColumn(c, F.lit(None).cast("long"))
    kind = F.col("detected_type")
    number = F.when(kind == "INVOICE", F.col("invoice_number")).when(kind == "PO", F.col("po_number")).when(kind == "GRN", F.col("grn_number"))
    own = own.select(
        "doc_id", kind.alias("kind"), number.alias("number"), F.col("vendor_id").alias("_vendor"), F.trim("vendor_name").alias("vendor_name"), F.col("purchase_order_id").alias("_po"), S.normalize_business_value("po_number").alias("_order"),
        F.col("doc_date").alias("date"), F.coalesce("currency", F.lit("USD")).alias("currency"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("subtotal", "tax_amount", "total_amount")), "lines",
    )
    known = None
    for name, table, key, no in (("PO", po, "po_id", "po_number"), ("GRN", grn, "grn_id", "grn_number"), ("INVOICE", inv, "invoice_id", "invoice_number")):
        part = table.groupBy(F.col(no).alias("number")).agg(F.min(key).cast("long").alias("id")).withColumn("kind", F.lit(name))
        known = part if known is None else known.unionByName(part)
    own = own.join(known, ["kind", "number"], "left")
    names = vendors.groupBy(F.col("name").alias("vendor_name")).agg(F.min("vendor_id").alias("_named"))
    orders = po.groupBy(F.col("po_number").alias("_order")).agg(F.min("po_id").alias("_found"))
    linked_vendor = vendors.select(F.col("vendor_id").alias("_vendor"), F.lit(True).alias("_has_vendor")).distinct()
    linked_order = po.select(F.col("po_id").alias("_po"), F.lit(True).alias("_has_po")).distinct()
    own = own.join(names, "vendor_name", "left").join(orders, "_order", "left").join(linked_vendor, "_vendor", "left").join(linked_order, "_po", "left")
    own = own.withColumns({"vendor_id": F.coalesce(F.when(F.col("_has_vendor"), F.col("_vendor")), F.col("_named")), "po_id": F.when(F.col("kind") != "PO", F.coalesce(F.when(F.col("_has_po"), F.col("_po")), F.col("_found")))})
    priced = F.col("kind").isin("PO", "INVOICE")
    reason = (
        F.when(F.col("number").isNull(), "no_number").when(F.col("id").isNotNull(), None).when(priced & F.col("vendor_id").isNull() & (F.coalesce("vendor_name", F.lit("")) == ""), "no_vendor")
        .when((F.col("kind") == "GRN") & F.col("po_id").isNull(), "no_order").when(F.col("date").isNull(), "no_date").when(F.coalesce(F.size("lines"), F.lit(0)) <= 0, "no_lines")
        .when(F.exists("lines", lambda x: x["quantity"].isNull() | (x["quantity"] <= 0)), "bad_quantity").when(priced & F.exists("lines", lambda x: x["unit_price"].isNull() | (x["unit_price"] < 0)), "bad_price")
    )
    own = own.withColumn("reason", reason)
    made = Window.partitionBy("kind", "number").orderBy("doc_id")
    valid = own.where("reason IS NULL").withColumn("_r", F.when(F.col("id").isNull(), F.row_number().over(made)))
    head = valid.where("_r = 1")
    numbered = head.select("doc_id", "kind", "po_id", F.posexplode("lines").alias("_i", "_l")).withColumn("line_number", F.coalesce("_l.line_number", F.col("_i") + 1).cast("long"))
    order_lines = po_line.groupBy("po_id", F.col("line_number").cast("long").alias("line_number")).agg(F.min("po_line_id").alias("po_line_id"))
    amount = lambda c: F.coalesce(F.col(f"_l.{c}"), F.lit(0)).alias(c)
    lines = numbered.join(order_lines, ["po_id", "line_number"], "left").select("doc_id", "kind", "line_number", F.col("_l.description").alias("description"), amount("quantity"), amount("unit_price"), amount("tax_rate"), "po_line_id")
    new = head.where(priced & F.col("vendor_id").isNull()).select(F.col("vendor_name").alias("name")).distinct()
    return Promotion(
        head.select("doc_id", "kind", "number", "vendor_id", "vendor_name", "po_id", "date", "currency", "subtotal", "tax_amount", "total_amount"),
        lines,
        new,
        valid.where("id IS NOT NULL OR _r > 1").select("doc_id", "kind", "number", "id"),
        own.where("reason IS NOT NULL").select("doc_id", "kind", "reason"),
    )


#: Fields of which a disagreement is financially significant, by the way their values compare.
IDENTIFIERS = ("invoice_number", "po_number", "grn_number", "vendor_name", "currency")
DATES = ("doc_date", "invoice_date", "order_date", "receipt_date")
_COMPARED = ("line_number", "description", "quantity", "unit_price", "tax_rate", "reference")


def unpivot_candidates(c: DataFrame) -> DataFrame:
    """Candidates as (doc_id, path, value): header fields, `lines[i].field`, and the number of lines as lines.count."""
    fields = (*IDENTIFIERS, "doc_date", "subtotal", "tax_amount", "total_amount")
    pair = lambda path, value: F.struct(path.alias("path"), value.cast("string").alias("value"))
    head = F.array(*(pair(F.lit(f), F.col(f)) for f in fields), pair(F.lit("lines.count"), F.coalesce(F.greatest(F.size("lines"), F.lit(0)), F.lit(0))))
    lines = F.flatten(F.transform("lines", lambda x, i: F.array(*(pair(F.concat(F.lit("lines["), i.cast("string"), F.lit(f"].{f}")), x[f]) for f in _COMPARED))))
    return c.select("doc_id", F.explode(F.concat(head, F.coalesce(lines, F.array().cast("array<struct<path:string,value:string>>")))).alias("e")).select("doc_id", "e.*")


def compare_candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc_id, path, value) on both sides -> result (agreement, disagreement, a_only, b_only, missing) and financial.

    Amounts compare as numbers, dates as dates, line numbers as integers, others as folded text; empty on both sides is
    missing. lines.count shows only where it differs. financial marks disagreements on amounts, identifiers, dates and
    the number of lines.
    """
    left, right = a.select("doc_id", "path", F.nullif(F.trim("value"), F.lit("")).alias("a")), b.select("doc_id", "path", F.nullif(F.trim("value"), F.lit("")).alias("b"))
    both = left.join(right, ["doc_id", "path"], "full_outer")
    name = F.regexp_replace("path", r"^lines\[\d+\]\.", "")
    equal = lambda f: F.coalesce(f(F.col("a")) == f(F.col("b")), F.lit(False))
    text = equal(S.eval_name)
    number = F.coalesce(F.col("a").try_cast("int") == F.col("b").try_cast("int"), text)
    same = F.when(name.isin(*FINANCIAL), equal(S.eval_decimal)).when(name.isin(*DATES), equal(S.eval_date)).when(name.isin("line_number", "lines.count"), number).otherwise(text)
    none_a, none_b = F.col("a").isNull(), F.col("b").isNull()
    result = F.when(none_a & none_b, "missing").when(none_b, "a_only").when(none_a, "b_only").when(same, "agreement").otherwise("disagreement")
    out = both.withColumn("result", result).withColumn("financial", (F.col("result") == "disagreement") & name.isin(*FINANCIAL, *IDENTIFIERS, *DATES, "lines.count"))
    return out.where("path <> 'lines.count' OR result = 'disagreement'")


def _folded(c: Column) -> Column:
    """Blanks as one, and case folded, sharp s and the like included."""
    return F.lower(F.upper(F.regexp_replace(F.trim(c), r"\s+", " ")))


def _holds(text: Column, value: Column) -> Column:
    """Whether text contains value, after folding, then without punctuation; nothing contains an empty value."""
    bare = lambda c: F.regexp_replace(_folded(c), r"[^\p{L}\p{N}_ ]", "")
    return F.coalesce((_folded(value) != "") & (F.contains(_folded(text), _folded(value)) | ((bare(value) != "") & F.contains(bare(text), bare(value)))), F.lit(False))


def grounded_values(values: DataFrame, docs: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """Whether the text of its document supports each value(doc_id, path, value); empty values aren't asked for.

    A value is grounded if the text holds it, or holds a snippet that was claimed for it (evidence(doc_id, field_name,
    snippet); field_name is the path or its last part) and that itself holds the value.
    """
    own = values.where(F.trim("value") != "").withColumn("_leaf", F.regexp_replace("path", r"^.*\.", "")).join(docs.select("doc_id", "full_text"), "doc_id")
    if evidence is None:
        claimed = F.array().cast("array<string>")
    else:
        said = evidence.groupBy("doc_id", "field_name").agg(F.collect_set("snippet").alias("_said"))  # snippets for one field of a document
        for key in ("path", "_leaf"):
            own = own.join(said.select("doc_id", F.col("field_name").alias(key), F.col("_said").alias(f"_said_{key}")), ["doc_id", key], "left")
        none = F.array().cast("array<string>")
        claimed = F.array_union(F.coalesce("_said_path", none), F.coalesce("_said__leaf", none))
    text = F.coalesce("full_text", F.lit(""))
    grounded = _holds(text, F.col("value")) | F.exists(claimed, lambda c: _holds(text, c) & _holds(c, F.col("value")))
    return own.select("doc_id", "path", grounded.alias("grounded"), (F.size(claimed) > 0).alias("has_evidence"))


def unsupported_fields(grounded: DataFrame) -> DataFrame:
    """D14 per document: the sorted paths of values that nothing supports, and whether there are none."""
    paths = F.array_sort(F.collect_list(F.when(~F.col("grounded"), F.col("path"))))  # fields of one document
    return grounded.groupBy("doc_id").agg(paths.alias("unsupported")).withColumn("is_grounded", F.size("unsupported") == 0)


def quality_verdict(checks: DataFrame) -> DataFrame:
    """checks(doc_id, provider_error, structured_valid, unsupported, business_ok, financial_disagreements, one_sided)."""
    bad = F.col("provider_error").isNotNull() | ~F.col("structured_valid") | (F.size("unsupported") > 0) | ~F.col("business_ok") | (F.col("financial_disagreements") > 0)
    return checks.withColumn("quality", F.when(bad, "REVIEW_REQUIRED").when(F.col("one_sided") > 0, "MEDIUM").otherwise("HIGH"))


def needs_assist(understood: DataFrame) -> DataFrame:
    """Whether a second extractor is needed, with distinct reasons in order."""
    ready = F.col("outcome") == "READY_FOR_RECONCILIATION"
    codes = F.filter(F.transform("issues", lambda i: i["code"]), lambda c: c.isin(*ASSIST_CODES))
    reasons = F.array_distinct(F.concat(F.array_compact(F.array(F.when(~ready, F.concat(F.lit("outcome:"), "outcome")), F.when(F.col("detected_type") == "UNKNOWN", "type:UNKNOWN"), F.when(F.col("requires_review"), "requires_review"))), F.transform(codes, lambda c: F.concat(F.lit("issue:"), c)), F.when(F.size("lines") == 0, F.array(F.lit("no_lines"))).otherwise(F.array().cast("array<string>"))))
    return understood.select("doc_id", (~ready).alias("assist"), F.when(~ready, reasons).otherwise(F.array().cast("array<string>")).alias("reasons"))


def assist_status(checks: DataFrame) -> DataFrame:
    """checks(doc_id, grounded, hard_errors, financial_disagreements, quality) -> state and review priority."""
    state = F.when(~F.col("grounded"), "EVIDENCE_FAILED").when(F.col("hard_errors"), "VALIDATION_FAILED").when(F.col("financial_disagreements") > 0, "DISAGREEMENT").otherwise("INVOKED")
    priority = F.when((F.col("financial_disagreements") > 0) | ~F.col("grounded"), "HIGH").when(F.col("quality") == "HIGH", "LOW").otherwise("MEDIUM")
    return checks.withColumns({"state": state, "priority": priority})
