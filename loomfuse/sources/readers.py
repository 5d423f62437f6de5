"""Readers of the four source types. Each takes a DataFrame of (spec_idx, path, text) or a path, and gives RAW rows.

``READERS`` maps a type to its reader; further types can be added to it."""

import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomfuse.functions import rules as R
from loomfuse.functions.text import blank_to_null, clean, find_terms, first_match, let, lookup, no_strings, strip
from loomfuse.sources.ranges import delimited_records, json_records
from loomfuse.sources.schemas import as_raw

DOCUMENTS = (".pdf", ".docx", ".doc")


def detect_type(path: str) -> str | None:
    """Source type by the file's name, or None."""
    name = os.path.basename(path).lower()
    if name.endswith(".csv"):
        return "recruiter_csv"
    if name.endswith(".json"):
        return "ats_json"
    if name.endswith(DOCUMENTS):
        return "resume"
    if name.endswith(".txt"):
        return "resume" if "resume" in name or "cv" in name else "recruiter_notes"
    return None


def texts(spark: SparkSession, path: str, spec_idx: int = 0) -> DataFrame:
    """spec_idx, path, text: one row a file."""
    return spark.read.text(path, wholetext=True).select(F.lit(spec_idx).alias("spec_idx"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


# ---- delimited ---------------------------------------------------------------------------------------


def delimited_rows(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """RAW rows (and columns to keep) of name, email, phone, company, title and location (spec_idx and pos if there); those without a name, an e-mail and a phone go."""
    df = df.where("name is not null or email is not null or phone is not null")
    works = F.col("company").isNotNull() | F.col("title").isNotNull()
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).otherwise(no_strings())
    job = F.array(F.struct(F.col("company"), F.col("title"), F.lit(None).cast("string").alias("start"), F.lit("present").alias("end"), F.lit(None).cast("string").alias("summary")))
    return as_raw(df, keep=keep, source=F.lit("recruiter_csv"), full_name=F.col("name"), emails=one("email"), phones=one("phone"), location_text=F.col("location"), headline=F.when(works, F.col("title")), experience=F.when(works, job))


#: Columns of a delimited file at most; further cells are not read.
MOST_COLUMNS = 64


def read_delimited_files(spark: SparkSession, paths: str | list[str], specs: DataFrame | None = None) -> DataFrame:
    """Rows of delimited files, each with its own header, by byte ranges: columns by header spelling; of several for one key the first
    non-blank cell counts. ``file`` and ``error`` follow the RAW columns: what is not UTF-8 is an error."""
    records, headers = delimited_records(spark, paths)
    kind, options = ", ".join(f"c{i} string" for i in range(MOST_COLUMNS)), {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    cells = lambda c: let(F.from_csv(c, kind, options), lambda row: F.array(*(row[f"c{i}"] for i in range(MOST_COLUMNS))))
    title = lambda x: F.lower(F.trim(F.regexp_replace(x, "^\ufeff", "")))
    keys = F.transform(cells(F.col("text")), lambda x: lookup(R.CSV_HEADERS, title(x)))
    named = headers.where("text is not null").select("file", keys.alias("keys"))
    known = F.broadcast(with_specs(named, specs, "file"))  # a row a file
    df = records.where("text is not null").join(known, "file").withColumn("cells", F.transform(cells(F.col("text")), clean))
    get = lambda k: F.get(F.filter(F.zip_with("cells", "keys", lambda x, key: F.when(key == k, x)), lambda x: x.isNotNull()), F.lit(0))
    df = df.select("file", "spec_idx", ((F.col("file_no") * F.lit(1 << 42)) + F.col("pos")).alias("pos"), *(get(k).alias(k) for k in ("name", "email", "phone", "company", "title", "location")))
    good = delimited_rows(df, keep=("file",)).withColumn("error", F.lit(None).cast("string"))
    bad = records.where("text is null").select("file").unionByName(headers.where("text is null").select("file")).distinct()
    return good.unionByName(fault_rows(with_specs(bad, specs, "file"), F.lit("is not UTF-8 text")))


def with_specs(files: DataFrame, specs: DataFrame | None, col: str) -> DataFrame:
    """``files`` with spec_idx, the sources (spec_idx, root) at or above each file's path, and file_no, which numbers files by path."""
    numbered = files.withColumn("file_no", (F.dense_rank().over(W.orderBy(col)) - 1).cast("long"))
    if specs is None:
        return numbered.withColumn("spec_idx", F.lit(0))
    above = F.transform(F.sequence(F.lit(1), F.size(F.split(col, "/"))), lambda n: F.call_function("substring_index", F.col(col), F.lit("/"), n))
    return numbered.withColumn("root", F.explode(above)).join(F.broadcast(specs), "root").drop("root")


def fault_rows(files: DataFrame, error: Column) -> DataFrame:
    """A row with an error for each of ``files`` (file, spec_idx)."""
    return as_raw(files.select("spec_idx", F.lit(-1).alias("pos"), "file", error.alias("error")), keep=("file", "error"))


def read_delimited(spark: SparkSession, path: str, spec_idx: int = 0) -> DataFrame:
    """Rows with a name, an e-mail or a phone."""
    return read_delimited_files(spark, path).where("error is null").drop("file", "error").withColumn("spec_idx", F.lit(spec_idx))


# ---- JSON ----------------------------------------------------------------------------------------------


def json_value(v: Column, *keys: str) -> Column:
    """The variant of the first key that is present and not null, "", [] or {}."""
    each = []
    for k in keys:
        x = F.try_variant_get(v, f"$['{k}']", "variant")
        each.append(F.when(x.isNotNull() & ~F.is_variant_null(x) & ~F.to_json(x).isin('""', "[]", "{}"), x))
    return F.coalesce(*each)


def json_text(v: Column, *keys: str) -> Column:
    return F.try_variant_get(json_value(v, *keys), "$", "string")


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def json_list(v: Column, *keys: str) -> Column:
    """The array of the first present key; a text or an object alone is an array of one."""
    x = json_value(v, *keys)
    one = F.when(is_object(x) | (F.schema_of_variant(x) == "STRING"), F.array(x))
    return F.coalesce(F.try_variant_get(x, "$", "array<variant>"), one, F.array().cast("array<variant>"))


def read_json(files: DataFrame) -> DataFrame:
    """Applicants of JSON texts: a list, an object that wraps one, or a single object. Unreadable text gives no rows."""
    doc = files.select("spec_idx", F.try_parse_json("text").alias("v"))
    wraps = [F.try_variant_get("v", f"$.{k}", "array<variant>") for k in R.JSON_WRAPS]
    every = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), *wraps, F.when(is_object(F.col("v")), F.array("v")), F.array().cast("array<variant>"))
    return applicants(doc.select("spec_idx", F.posexplode(every).alias("pos", "a")).where(is_object(F.col("a"))))


def read_json_files(spark: SparkSession, paths: str | list[str], specs: DataFrame | None = None) -> DataFrame:
    """Applicants of JSON exports, by byte ranges; ``file`` and ``error`` follow the RAW columns. A file that ends early, or holds a record
    that is no JSON, is an error."""
    records, files = json_records(spark, paths, R.JSON_WRAPS)
    files = with_specs(files, specs, "file")
    df = records.join(F.broadcast(files.where("error is null").select("file", "spec_idx", "file_no")), "file").withColumn("a", F.try_parse_json("text"))
    df = df.select("file", "spec_idx", ((F.col("file_no") * F.lit(1 << 42)) + F.col("pos")).alias("pos"), "a")
    good = applicants(df.where("a is not null"), keep=("file",)).withColumn("error", F.lit(None).cast("string"))
    return good.unionByName(fault_rows(files.where("error is not null"), F.col("error"))).unionByName(fault_rows(df.where("a is null"), F.lit("holds a record that is not JSON")))


def applicants(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """RAW rows (and columns to keep) of spec_idx, pos, a: an object as a variant."""
    a, keys = F.col("a"), R.JSON_KEYS
    df = df.select("spec_idx", "pos", "a", *keep, *(json_value(a, *keys[k]).alias(k) for k in ("contact", "addr", "social", "years")))
    contact, addr, social, years = (F.col(c) for c in ("contact", "addr", "social", "years"))
    present = lambda *cs: F.filter(F.array(*cs), lambda x: x.isNotNull())
    text = lambda v, k: json_text(v, *keys[k])
    hub = text(social, "github")
    textual = F.schema_of_variant(years) == "STRING"
    strings = lambda x: F.filter(F.transform(x, lambda s: F.try_variant_get(s, "$", "string")), lambda s: s.isNotNull() & (s != ""))
    entries = lambda k, names: F.transform(F.filter(json_list(a, *keys[k]), is_object), lambda e: F.struct(*(json_text(e, *ks).alias(n) for n, ks in names.items())))
    return as_raw(
        df, keep=keep, source=F.lit("ats_json"), full_name=text(a, "full_name"), emails=present(text(contact, "email"), text(contact, "other_email"), json_text(a, "email")), phones=present(text(contact, "phone"), json_text(a, "phone")),
        city=text(addr, "city"), region=text(addr, "region"), country_text=text(addr, "country"), location_text=F.when(F.schema_of_variant(addr) == "STRING", F.try_variant_get(addr, "$", "string")),
        linkedin=text(social, "linkedin"), github=F.when(hub.startswith("http"), hub).otherwise(F.concat(F.lit("https://github.com/"), hub)), portfolio=text(social, "portfolio"), headline=text(a, "headline"),
        years_num=F.when(~textual, F.coalesce(F.try_variant_get(years, "$", "double"), F.try_variant_get(years, "$", "boolean").cast("double"))), years_txt=F.when(textual, F.try_variant_get(years, "$", "string")),
        skills=strings(json_list(a, *keys["skills"])), experience=entries("experience", R.JSON_JOB), education=entries("education", R.JSON_COURSE),
    )


# ---- notes ------------------------------------------------------------------------------------------------

def scan_phones(text: Column) -> Column:
    """Phone-like runs of 7 to 15 digits, each once."""
    return F.array_distinct(F.transform(F.filter(F.regexp_extract_all(text, F.lit(R.PHONE), F.lit(1)), lambda x: F.length(F.regexp_replace(x, r"(?U)\D", "")).between(7, 15)), strip))


def scan_emails(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(R.EMAIL), F.lit(0)))


def scan_links(text: Column) -> Column:
    """Addresses with a path, in the order of the text."""
    return F.regexp_extract_all(text, F.lit(R.URL), F.lit(1))


def scan_skills(text: Column) -> Column:
    """Every spelling of a skill that stands by itself, longer ones first."""
    return find_terms(F.lower(text), R.SKILL_SPELLINGS)


def split_notes(text: Column) -> Column:
    """Blocks: before each label, else paragraphs."""
    blocks = F.when(text.rlike(R.NOTE_LABEL), F.split(text, R.NOTE_BLOCK)).otherwise(F.split(text, r"\n\s*\n"))
    return F.filter(blocks, lambda b: strip(b) != "")


def note_name(block: Column) -> Column:
    value = strip(F.get(F.split(strip(F.regexp_extract(block, R.NOTE_LABEL, 1)), R.NOTE_NAME_END), F.lit(0)))
    return blank_to_null(F.regexp_replace(F.regexp_replace(value, R.EMAIL, ""), r"^[ .,\-]+|[ .,\-]+$", ""))


def read_notes(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """A record for each block with a name, an e-mail, a phone or a skill."""
    df = files.select("spec_idx", *keep, F.posexplode(split_notes(F.col("text"))).alias("pos", "block"))
    b = F.col("block")
    df = df.select("spec_idx", *keep, "pos", note_name(b).alias("full_name"), scan_emails(b).alias("emails"), scan_phones(b).alias("phones"), first_match(b, R.NOTE_YEARS, 1).alias("years_txt"), scan_skills(b).alias("skills"))
    return as_raw(df.where("full_name is not null or size(emails) > 0 or size(phones) > 0 or size(skills) > 0"), keep=keep, source=F.lit("recruiter_notes"))


# ---- résumés ----------------------------------------------------------------------------------------------

ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def heading(line: Column) -> Column:
    """Section that a line opens, or null."""
    x = F.lower(F.regexp_replace(strip(line), "^:+|:+$", ""))
    return F.when(F.length(x) <= 30, lookup(R.HEADINGS, x))


def looks_like_name(line: Column) -> Column:
    s = strip(line)
    tokens = F.split(s, r"(?U)\s+")
    return (s != "") & ~s.rlike(r"(?U)[@\d]") & (F.size(tokens) <= 4) & F.forall(tokens, lambda t: t.rlike(r"^[A-Za-z.\-']+$")) & F.exists(tokens, lambda t: t.rlike("^[A-Z]"))


def sections(lines: Column) -> Column:
    """array<struct<section, line>>: "" before the first heading; headings themselves are left out."""
    start = F.struct(F.lit("").alias("at"), F.array().cast("array<struct<section:string,line:string>>").alias("out"))
    step = lambda s, x: F.struct(F.coalesce(heading(x), s["at"]).alias("at"), F.when(heading(x).isNotNull(), s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(s["at"].alias("section"), x.alias("line"))))).alias("out"))
    return F.aggregate(lines, start, step, lambda s: s["out"])


def split_job(head: Column) -> Column:
    """struct<title, company> of the text before a date range."""
    cut = lambda sep: (F.regexp_extract(head, rf"(?s)^(.*?){sep}(.*)$", 1), F.regexp_extract(head, rf"(?s)^(.*?){sep}(.*)$", 2))
    out = F.struct(clean(head).alias("title"), F.lit(None).cast("string").alias("company"))
    for sep in (",", r"\|", " - ", "–", "—", r"(?iU)\s+at\s+"):
        a, b = cut(sep)
        out = F.when(head.rlike(sep), F.struct(clean(a).alias("title"), clean(b).alias("company"))).otherwise(out)
    return out


def experience(lines: Column) -> Column:
    """Entries: a line with a date range that is no bullet opens one, later lines are its summary."""
    bullet = r"(?U)^[\-•*·]\s+"
    kind = "array<struct<company:string,title:string,start:string,end:string,summary:string>>"
    def step(s: Column, raw: Column) -> Column:
        line = strip(raw)
        opens = line.rlike(R.DATE_RANGE) & ~line.rlike(bullet)
        first = F.regexp_extract(line, R.DATE_RANGE, 0)
        head = strip(F.regexp_replace(F.call_function("substring_index", line, first, F.lit(1)), r"^[ ,|—–\-]+|[ ,|—–\-]+$", ""))
        job = split_job(head)
        entry = F.struct(job["company"].alias("company"), job["title"].alias("title"), F.regexp_extract(line, R.DATE_RANGE, 1).alias("start"), F.regexp_extract(line, R.DATE_RANGE, 2).alias("end"), F.lit(None).cast("string").alias("summary"))
        last = F.get(s, F.size(s) - 1)
        more = F.struct(last["company"].alias("company"), last["title"].alias("title"), last["start"].alias("start"), last["end"].alias("end"), F.concat_ws(" ", last["summary"], F.regexp_replace(line, bullet, "")).alias("summary"))
        return F.when(line == "", s).when(opens, F.concat(s, F.array(entry))).when(F.size(s) > 0, F.concat(F.slice(s, F.lit(1), F.size(s) - 1), F.array(more))).otherwise(s).cast(kind)
    return F.aggregate(lines, F.array().cast(kind), step)


def education(lines: Column) -> Column:
    """Entries by comma parts: year, degree (and its field), institution by keyword, else what is left."""
    def one(raw: Column) -> Column:
        line = strip(F.regexp_replace(strip(raw), r"^[\-•*· ]+", ""))
        parts = F.filter(F.transform(F.split(line, ","), strip), lambda p: (p != "") & ~p.rlike(r"^(?:19|20)\d{2}$"))
        is_degree, is_school = (lambda p: p.rlike(R.DEGREE)), (lambda p: F.lower(p).rlike("|".join(R.INSTITUTIONS)))
        start = F.struct(*(F.lit(None).cast("string").alias(n) for n in ("degree", "field", "school")), no_strings().alias("rest"))
        def step(s: Column, p: Column) -> Column:
            degree, school = s["degree"].isNull() & is_degree(p), s["school"].isNull() & is_school(p)
            after = F.regexp_replace(F.regexp_replace(p, R.DEGREE, ""), r"^[ .,\-]+|[ .,\-]+$", "")
            field = clean(F.regexp_replace(after, r"(?iU)^(?:in|of)\s+", ""))
            return F.struct(
                F.when(degree, strip(F.regexp_extract(p, R.DEGREE, 1))).otherwise(s["degree"]).alias("degree"), F.when(degree, F.coalesce(field, s["field"])).otherwise(s["field"]).alias("field"),
                F.when(~degree & school, p).otherwise(s["school"]).alias("school"), F.when(~degree & ~school, F.concat(s["rest"], F.array(p))).otherwise(s["rest"]).alias("rest"),
            )
        def finish(s: Column) -> Column:
            takes = s["school"].isNull()
            rest = F.when(takes, F.get(s["rest"], F.lit(1))).otherwise(F.get(s["rest"], F.lit(0)))
            return F.struct(F.coalesce(s["school"], F.get(s["rest"], F.lit(0))).alias("institution"), s["degree"].alias("degree"), F.coalesce(s["field"], rest).alias("field"), first_match(line, r"(?:19|20)\d{2}").alias("end_year"))
        return F.aggregate(parts, start, step, finish)
    full = F.transform(lines, one)
    return F.filter(full, lambda e: e["institution"].isNotNull() | e["degree"].isNotNull() | e["field"].isNotNull() | e["end_year"].isNotNull())


def read_resumes(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One record a file with a name or an e-mail."""
    rows = files.where(strip("text") != "").select("spec_idx", *keep, "path", "text", F.transform(F.split("text", ENDS), lambda x: F.regexp_replace(x, r"(?U)\s+$", "")).alias("lines"))
    rows = rows.select("*", sections(F.col("lines")).alias("parts"))
    of = lambda name: F.transform(F.filter("parts", lambda p: p["section"] == name), lambda p: p["line"])
    rows = rows.select("*", F.filter(of(""), lambda x: strip(x) != "").alias("header"))
    rows = rows.select("*", F.array_position(F.transform("header", looks_like_name), True).alias("at"))
    plain = lambda x: ~x.contains("@") & ~x.rlike(R.PHONE) & ~x.contains("|") & ~x.rlike(R.URL)
    later = F.filter(F.slice("header", F.col("at").cast("int") + 1, F.greatest(F.size("header"), F.lit(1))), plain)
    links = scan_links(F.col("text"))
    in_ = "linkedin"
    is_in, is_hub = (lambda u: F.lower(u).contains(in_)), (lambda u: F.lower(u).contains("github"))
    linkedin = F.get(F.filter(links, is_in), F.lit(0))
    # a second LinkedIn address that also says github counts as the GitHub one
    later_in = F.slice(F.filter(links, lambda u: is_in(u) & is_hub(u)), 2, 1_000_000)
    github = F.get(F.filter(links, lambda u: is_hub(u) & (~is_in(u) | F.array_contains(later_in, u))), F.lit(0))
    trim = lambda s: F.regexp_replace(s, r"^[ \-•*·]+|[ \-•*·]+$", "")
    skills = F.filter(F.transform(F.split(F.array_join(of("skills"), " , "), r"[,\n|/]"), trim), lambda s: s != "")
    named = F.col("at") > 0
    df = rows.select(
        "spec_idx", *keep, F.monotonically_increasing_id().alias("pos"), F.when(named, strip(F.get("header", F.col("at").cast("int") - 1))).alias("full_name"), scan_emails(F.col("text")).alias("emails"), scan_phones(F.col("text")).alias("phones"),
        linkedin.alias("linkedin"), github.alias("github"), F.when(named, strip(F.get(later, F.lit(0)))).alias("headline"), skills.alias("skills"), experience(of("experience")).alias("experience"), education(of("education")).alias("education"),
    )
    return as_raw(df.where("full_name is not null or size(emails) > 0"), keep=keep, source=F.lit("resume"))


def document_text(content: bytes, path: str) -> str | None:
    """Text of a DOCX (paragraphs by lines), a PDF (if a parser is installed), or UTF-8 bytes; None if it cannot be read."""
    import io
    import zipfile
    from xml.etree import ElementTree

    low = path.lower()
    try:
        if low.endswith((".docx", ".doc")):
            w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                tree = ElementTree.fromstring(z.read("word/document.xml"))
            return "\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in tree.iter(f"{w}p"))
        if low.endswith(".pdf"):
            import pdfplumber

            with pdfplumber.open(io.BytesIO(content)) as pdf:
                return "\n".join(page.extract_text() or "" for page in pdf.pages)
        return content.decode("utf-8", "ignore")
    except Exception:  # noqa: BLE001  one bad file must not end the others
        return None


@F.pandas_udf(T.StringType())
def text_of(content: pd.Series, path: pd.Series) -> pd.Series:
    return pd.Series([document_text(c, p) for c, p in zip(content, path)], dtype=object)


def documents(spark: SparkSession, path: str, spec_idx: int = 0) -> DataFrame:
    """spec_idx, path, text of document files, read as bytes."""
    return spark.read.format("binaryFile").load(path).select(F.lit(spec_idx).alias("spec_idx"), "path", text_of("content", "path").alias("text"))


def whole_files(read, text, error: str):
    """A reader of files that are one text each, by ``read(files, keep)``; those whose ``text(content, path)`` is null are errors."""

    def reader(spark: SparkSession, paths: str | list[str], specs: DataFrame | None = None) -> DataFrame:
        names = spark.read.format("binaryFile").load(paths).select("path")
        files = spark.read.format("binaryFile").load(paths).select("path", text("content", "path").alias("text"))
        files = files.join(F.broadcast(with_specs(names, specs, "path")), "path")  # a row a file
        good = read(files.where("text is not null"), ("file_no", "path"))
        good = good.withColumn("pos", F.col("file_no") * F.lit(1 << 42) + (F.lit(0) if read is read_resumes else F.col("pos")))
        good = good.drop("file_no").withColumnRenamed("path", "file").withColumn("error", F.lit(None).cast("string"))
        return good.unionByName(fault_rows(files.where("text is null").withColumnRenamed("path", "file"), F.lit(error)))

    return reader


#: Readers of many files at once, of (spark, paths, specs): RAW rows, file and error.
FILE_READERS = {
    "recruiter_csv": read_delimited_files,
    "ats_json": read_json_files,
    "resume": whole_files(read_resumes, text_of, "cannot be read as a document"),
    "recruiter_notes": whole_files(read_notes, lambda content, _: F.try_validate_utf8(F.col(content).cast("string")), "is not UTF-8 text"),
}
READERS = {
    "recruiter_csv": read_delimited,
    "ats_json": lambda spark, path, i=0: read_json_files(spark, path).where("error is null").drop("file", "error").withColumn("spec_idx", F.lit(i)),
    "resume": lambda spark, path, i=0: read_resumes(documents(spark, path, i)),
    "recruiter_notes": lambda spark, path, i=0: read_notes(texts(spark, path, i)),
}
#: Readers of text that is at hand (spec_idx, path, text) instead of in files.
TEXT_READERS = {"ats_json": read_json, "resume": read_resumes, "recruiter_notes": read_notes}
