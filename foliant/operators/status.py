"""Decision tables and summaries: batch runs, logs, signatures, provenance, versions, files."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import strings

#: Fixed values.
OFFICE_EXTENSIONS = ["docx", "doc", "xlsx", "xls", "pptx", "ppt", "odt", "ods", "odp", "rtf", "csv", "txt"]
OCR_LANGUAGES = ["ara", "chi_sim", "chi_tra", "deu", "eng", "fra", "ita", "jpn", "kor", "nld", "osd", "por", "rus", "spa"]
SEVERITIES = ["Info", "Warning", "Error", "Critical"]
CONVERT_EXTENSIONS = [".docx", ".xlsx", ".html", ".png", ".csv"]
OUTPUT_SUFFIXES = {"compress": "_compressed.pdf", "watermark": "_watermarked.pdf", "pdfa": "_pdfa.pdf"}
COMPRESS_PRESETS = [("Screen", 72, 50, True), ("Ebook", 150, 75, False), ("Printer", 300, 85, False)]
PERMISSIONS = {"print": 3, "modify": 4, "copy": 5, "annotate": 6, "fill_forms": 9, "accessibility": 10, "assemble": 11, "print_high": 12}
#: Longest sides in pixels, and most pixels of a rendering.
OCR_SIDE, RENDER_SIDE, RENDER_PIXELS, OPTIMIZE_SIDE = 10_000, 20_000, 120_000_000, 10_000
#: (name, least and most short side, least and most long side), in points.
PAGE_SIZES = [("A4", 590, 600, 835, 847), ("Letter", 605, 618, 785, 798), ("Legal", 605, 618, 1000, 1015)]
BLANK_INK = 0.0035


def run_batch(files: DataFrame, path: str, work: Callable[[str], str]) -> DataFrame:
    """(path, ok, result, error) of each file: one that fails is a row, not the end of the run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p in b.column(0).to_pylist():
                try:
                    rows.append((p, True, work(p), None))
                except Exception as e:  # the run goes on; the error is data
                    rows.append((p, False, None, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.bool_(), pa.string(), pa.string()))], ["path", "ok", "result", "error"])

    return files.select(path).mapInArrow(run, "path string, ok boolean, result string, error string")


def batch_summary(rows: DataFrame, keys: list[str], severity: str) -> DataFrame:
    """Counts by outcome; errors are severities from Error on."""
    level = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col(severity))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if(level >= 3).alias("errors"),
        F.count_if(level == 2).alias("warnings"),
        F.count_if(level < 3).alias("succeeded"),
        F.bool_or(level >= 3).alias("has_errors"),
    )


def eta_ms(elapsed: Column, done: Column, total: Column) -> Column:
    """Whole milliseconds a file, times the files left; null before the first and after the last."""
    per_file = F.try_divide(elapsed - F.pmod(elapsed, done), done)
    return F.when((done > 0) & (done < total), (per_file * (total - done)).cast("bigint"))


def log_csv(log: DataFrame) -> DataFrame:
    """One line an entry; the page is blank if it is negative."""
    q = strings.csv_quote
    page = F.when(F.col("page") >= 0, F.col("page").cast("string")).otherwise("")
    cells = [q(F.col("timestamp")), q(F.col("severity")), q(F.col("file")), page, q(F.col("message")), q(F.col("details"))]
    return log.select("entry", F.concat_ws(",", *cells).alias("value"))


LOG_HEADER = "Timestamp,Severity,File,Page,Message,Technical Details"


def log_json(log: DataFrame) -> DataFrame:
    """One object an entry, without a file that is empty and a page that is negative."""
    body = F.struct(
        "timestamp", "severity", "message", F.col("details").alias("technicalDetails"), F.when(F.col("file") != "", F.col("file")).alias("file"), F.when(F.col("page") >= 0, F.col("page")).alias("page")
    )
    return log.select("entry", F.to_json(body).alias("value"))


def output_path(path: Column, operation: str, out_dir: Column | None = None, extension: str = ".out") -> Column:
    """Where a batch writes: the folder given or the file's own, its name and the operation's ending."""
    own = F.regexp_replace(path, "/[^/]*$", "")
    folder = own if out_dir is None else F.when(F.trim(out_dir) != "", F.trim(out_dir)).otherwise(own)
    ending = extension if operation == "convert" else OUTPUT_SUFFIXES[operation]
    return F.concat(folder, F.lit("/"), strings.file_stem(path), F.lit(ending))


def is_office(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(OFFICE_EXTENSIONS)


def within_limits(w: Column, h: Column, use: str) -> Column:
    if use == "render":
        return (w <= RENDER_SIDE) & (h <= RENDER_SIDE) & (w.cast("bigint") * h <= RENDER_PIXELS)
    side = OCR_SIDE if use == "ocr" else OPTIMIZE_SIDE
    return (w <= side) & (h <= side)


def is_newer(remote: Column, local: Column) -> Column:
    """Versions by numeric parts; what is missing or no number counts as 0."""
    parts = lambda v: F.transform(F.split(v, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))
    a, b = parts(remote), parts(local)
    n = F.greatest(F.size(a), F.size(b))
    pad = lambda x: F.concat(x, F.array_repeat(F.lit(0), n - F.size(x)))
    return pad(a) > pad(b)


def compress_preset(name: Column) -> Column:
    """struct<dpi, quality, strip_metadata> of a preset, null for a name that is none."""
    out = F.lit(None).cast("struct<dpi:int,quality:int,strip_metadata:boolean>")
    for n, dpi, quality, strip in COMPRESS_PRESETS:
        out = F.when(name == n, F.struct(F.lit(dpi).alias("dpi"), F.lit(quality).alias("quality"), F.lit(strip).alias("strip_metadata"))).otherwise(out)
    return out


def provenance_verdict(origin: Column, signed: Column, path: Column) -> Column:
    """error: a full rewrite of a signed document; warn: of an unsigned one born as PDF; else allow."""
    rewrite = path == "DjotThenSave"
    return F.when(rewrite & signed, "error").when(rewrite & (origin == "BornPDF"), "warn").otherwise("allow")


def byte_range_status(r: Column, size: Column, contents: Column) -> Column:
    """Of a signature's byte range (array of four numbers) in a file: the first fault, or Ok."""
    off1, len1, off2, len2 = (F.get(r, i) for i in range(4))
    return (
        F.when(r.isNull(), "Unsigned")
        .when(F.size(r) != 4, "Malformed")
        .when((off1 < 0) | (len1 < 0) | (off2 < 0) | (len2 < 0), "Malformed")
        .when(off1 + len1 > off2, "ByteRangeOverlap")
        .when(off1 != 0, "ByteRangeMismatch")
        .when(off2 + len2 > size, "ByteRangeMismatch")
        .when(contents.isNull(), "Unsigned")
        .otherwise("Ok")
    )


def trust_status(df: DataFrame) -> Column:
    """From the flag columns of a checked signature: the reason of most weight, then what revocation and later changes take away."""
    c = F.col
    passed = (
        F.when(c("weak_key"), "WeakKey").when(c("cert_expired"), "CertExpired")
        .when(c("eku_ok") & c("time_ok"), F.when(c("has_dss"), "ValidWithDSS").otherwise("Valid"))
        .when(~c("eku_ok"), "InvalidEKU").otherwise("SigningTimeOutOfRange")
    )
    failed = (
        F.when(c("weak_key"), "WeakKey").when(c("cert_expired"), "CertExpired").when(c("forged_crl"), "Invalid")
        .when(c("untrusted_chain") | c("integrity_ok"), "UntrustedChain").otherwise("Invalid")
    )
    status = F.when(c("verified"), passed).otherwise(failed)
    valid = lambda s: s.isin("Valid", "ValidWithDSS")
    open_ = ~status.isin("WeakKey", "CertExpired")
    matched = F.when(open_ & c("ocsp_no_match") & valid(status), "UntrustedChain").otherwise(status)
    revoked = F.when(open_ & c("ocsp_revoked"), "Revoked").otherwise(matched)
    return F.when(c("unsigned_trailing") & valid(revoked), "ValidWithUnsignedChanges").otherwise(revoked)


def ocsp_matched(signatures: DataFrame, responses: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ocsp_no_match: the document has responses, but none for the signer's certificate."""
    own = responses.select(*keys, "serial", "issuer_hash", F.lit(True).alias("_hit")).distinct()
    some = responses.select(*keys, F.lit(True).alias("_any")).distinct()
    j = signatures.join(own, [*keys, "serial", "issuer_hash"], "left").join(some, keys, "left")
    return j.withColumn("ocsp_no_match", F.col("_any").isNotNull() & F.col("_hit").isNull()).drop("_hit", "_any")


def permissions(flags: Column) -> list[Column]:
    """One boolean for each permission of a flag number; bits count from 1."""
    return [(F.shiftright(flags, bit - 1).bitwiseAND(F.lit(1)) == 1).alias(name) for name, bit in PERMISSIONS.items()]


def stale(modified: Column, as_of: datetime.datetime, hours: int = 24) -> Column:
    return modified < F.lit(as_of) - F.expr(f"INTERVAL {hours} HOURS")


def orphan_autosaves(saves: DataFrame, originals: DataFrame, key: str) -> DataFrame:
    """Autosaves whose original is missing or older."""
    o = originals.select(key, F.col("modified").alias("_m"))
    return saves.join(o, key, "left").filter(F.col("_m").isNull() | (F.col("modified") > F.col("_m"))).drop("_m")


def page_size(w: Column, h: Column) -> Column:
    short, long = F.least(F.round(w), F.round(h)), F.greatest(F.round(w), F.round(h))
    out = F.lit("Custom")
    for name, a, b, c, d in reversed(PAGE_SIZES):
        out = F.when(short.between(a, b) & long.between(c, d), name).otherwise(out)
    return out


def header_version(content: Column) -> Column:
    head = F.decode(F.substring(content, 1, 8), "ISO-8859-1")
    return F.when(head.startswith("%PDF-"), F.trim(F.substring(head, 6, 3))).otherwise("1.7")


def watermark(page_w: Column, page_h: Column, image_w: Column, image_h: Column, scale: float, position: Column) -> Column:
    """struct<x, y, w, h> of an image watermark, with margins of 20; tiles start at the corner."""
    w = page_w * scale
    h = w * (image_h.cast("double") / image_w)
    left, right, bottom, top = F.lit(20.0), page_w - w - 20, F.lit(20.0), page_h - h - 20
    x = F.when(position == "Center", (page_w - w) / 2).when(position.isin("TopLeft", "BottomLeft"), left).when(position.isin("TopRight", "BottomRight"), right).otherwise(F.lit(0.0))
    y = F.when(position == "Center", (page_h - h) / 2).when(position.isin("TopLeft", "TopRight"), top).when(position.isin("BottomLeft", "BottomRight"), bottom).otherwise(F.lit(0.0))
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def hit_rate(events: DataFrame, keys: list[str], hit: Column) -> DataFrame:
    return events.groupBy(*keys).agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), (F.count_if(hit) / F.count("*")).alias("rate"))
