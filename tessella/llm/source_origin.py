"""Problem 3: source files that nobody wrote by hand for this repository.

Layout statistics of every file (maximum and mean line length, white-space
share, alphanumeric share, numeric-literal density, share of long encoded
runs) are held against thresholds tuned per language: the medians and
quartiles of the language over all files set where hand-written text ends.
To that come what a file says of itself in its first comment lines, path
segments of the vendor kind, the commit that first added it (its size and
its subject), and whether its code, apart from comments and blank lines, is
that of a file in a vendor folder.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.joins import lookup_join
from tessella.scratch import Scratch

# Path segments of the vendor kind and the size of a bulk import.
VENDOR_PATH_SEGMENTS = ("vendor", "third_party", "external")
BULK_IMPORT_FILES = 100
# Other folders in which package managers and developers keep others' sources. Only whole
# segments count, without regard to case, hyphens, dots and underscores: not plurals or longer names.
VENDOR_FOLDERS = ("vendored", "extern", "3rd_party", "node_modules", "bower_components", "jspm_packages", "site-packages", "godeps")
# Subjects of commits that bring in others' files.
VENDOR_SUBJECT = (
    r"(?i)\b(?:vendor(?:ed|ing|s)?|port(?:ed|ing)?|import(?:ed)? from|imported .{1,60} from|copied|migrat(?:e|ed|ion)|upstream|bundled copy|third[- ]party|verbatim)\b"
)
# What generators and copies say of themselves.
GENERATED = re.compile(
    r"code generated by|@generated\b|\bauto-?generated\b|automatically (?:produced|generated|created)|automatisch (?:erzeugt|generiert)|généré automatiquement|generado automáticamente"
    r"|\bmachine (?:written|generated)|\bgenerated (?:from|by|with) [\w./-]+|^\W*output of \S+|manual edits are overwritten|changes will be (?:lost|overwritten)",
    re.I,
)
COPIED = re.compile(
    r"\blocal copy of\b|redistributed (?:unchanged|verbatim)|taken verbatim|copied verbatim|licen[cs]e shipped with (?:that|the) (?:library|project|package)|this file is part of .{1,60}\bversion\b|\bvendored (?:from|copy)\b"
    r"|kept in step with its releases|report problems to that project",
    re.I,
)
COMMENT = re.compile(r"\s*(?:#|//|--|/\*|\*|/-|<!--|;|%|\"\"\"|''')")
#: Lines at the top of a file whose comments may hold such a statement, even if code stands between them.
HEAD_LINES = 15
# Beginnings of comments over several lines, with their ends.
BLOCK = re.compile(r"\s*(/\*|/-|<!--|\"\"\"|''')")
BLOCK_END = {"/*": "*/", "/-": "-/", "<!--": "-->", '"""': '"""', "'''": "'''"}

NUMBER = re.compile(r"(?<![\w.])-?(?:0[xX][0-9a-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?)(?!\w)|(?<=\")\d[\d,.;]{5,}|(?<![A-Za-z\d])\d[\d,.]{5,}")
ENCODED = re.compile(r"[A-Za-z0-9+/]{48,}={0,2}|(?:\\x[0-9a-fA-F]{2}){8,}|(?:0x[0-9a-fA-F]{2},?\s?){16,}|[0-9a-fA-F]{64,}")
LINE_END = re.compile(r"\r\n|\r|\n")

#: Code shorter than this is not told a copy by being equal to that of a vendored file.
LEAST_COPY_CHARS = 120

#: How far beyond the quartiles hand-written files may lie, in distances from median to quartile.
REACH = 12.0
#: Distances count as at least this share of the median (of what lies above it, for alphanumerics).
LEAST_SPREAD = {"mean_line": 0.15, "max_line": 0.15, "numeric": 0.15, "space": 0.06, "alnum": 0.05}
#: With so many distinct files a language's own thresholds count as much as those of all files; with more, more.
LEAST_FILES = 30
#: No threshold is drawn tighter than this.
LOOSEST = {"mean_line": 80.0, "max_line": 180.0, "numeric": 0.05, "encoded": 0.25, "space": 0.06, "alnum": 0.86}
#: No threshold is drawn wider than this, and files beyond it don't count for the quartiles.
WIDEST = {"mean_line": 300.0, "max_line": 600.0, "numeric": 0.10, "encoded": 0.50, "space": 0.03, "alnum": 0.95}
#: This quantile of encoded runs in a language is added to their least limit.
ENCODED_AT = 0.98

STATS = ("n_chars", "max_line", "mean_line", "space", "alnum", "numeric", "encoded")
_UPPER = ("mean_line", "max_line", "numeric", "alnum")
TUNED = (*_UPPER, "space", "encoded")


def layout(text: str) -> tuple[float, ...]:
    """The STATS of a text; all 0 for an empty or blank one. Line ends of all kinds, blank lines don't count."""
    lines = [len(x) for x in LINE_END.split(text) if x.strip()]
    if not lines:
        return (float(len(text)), 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
    body = "".join(text.split())
    n = len(text)
    return (
        float(n),
        float(max(lines)),
        sum(lines) / len(lines),
        1 - len(body) / n,
        sum(map(str.isalnum, body)) / n,
        sum(len(m) for m in NUMBER.findall(text)) / n,
        sum(len(m) for m in ENCODED.findall(text)) / n,
    )


def _head(text: str) -> Iterator[str]:
    """Comment lines of the first HEAD_LINES lines and of the leading run of comment and blank lines, however long.

    The inner lines of a comment of several lines count too; those of a doc
    string only if they look like comment lines themselves.
    """
    begin, n, run, end, doc = 0, 0, True, "", False
    while begin <= len(text) and (run or n < HEAD_LINES):
        at = LINE_END.search(text, begin)
        line = text[begin : at.start() if at else len(text)]
        begin = at.end() if at else len(text) + 1
        n += 1
        opened = None if end else BLOCK.match(line)
        if COMMENT.match(line) or (end and run and not doc):
            yield line
        elif line.strip() and not end:
            run = False
        if opened:
            end = BLOCK_END[opened[1]]
            doc = opened[1] in ('"""', "'''") or line[opened.start(1) :].startswith(("/--", "/-!"))
        if end and end in line[opened.end() if opened else 0 :]:
            end = ""


def statements(text: str) -> tuple[bool, bool]:
    """Whether the comment lines at the top say that the file is generated, or a copy."""
    head = list(_head(text))
    return any(GENERATED.search(x) for x in head), any(COPIED.search(x) for x in head)


def code_key(text: str) -> int | None:
    """A 64-bit hash of the lines that are neither blank nor comments, without their line ends and trailing blanks; null for short ones.

    Comments of one line, and all lines of block comments, don't count; doc strings do.
    """
    kept, end = [], ""
    for line in LINE_END.split(text):
        if end:
            at = line.find(end)
            if at < 0:
                continue
            line, end = line[at + len(end) :], ""
        opened = BLOCK.match(line)
        if opened and opened[1] not in ('"""', "'''"):
            at = line.find(BLOCK_END[opened[1]], opened.end())
            if at < 0:
                end = BLOCK_END[opened[1]]
            continue
        if line.strip() and (opened or not COMMENT.match(line)):
            kept.append(line.rstrip())
    code = "\n".join(kept)
    if len(code) < LEAST_COPY_CHARS:
        return None
    return int.from_bytes(hashlib.blake2b(code.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, flags, keys = [], [], []
        for text in batch.column(1).to_pylist():
            rows.append(layout(text or ""))
            flags.append(statements(text or ""))
            keys.append(code_key(text or ""))
        table = np.array(rows, float).reshape(-1, len(STATS))
        said = np.array(flags, bool).reshape(-1, 2)
        arrays = [batch.column(0), *[batch.column(i) for i in range(2, batch.num_columns)], *[pa.array(table[:, i]) for i in range(len(STATS))], pa.array(said[:, 0]), pa.array(said[:, 1]), pa.array(keys, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=["file_id", *batch.schema.names[2:], *STATS, "says_generated", "says_copied", "code_key"])


def tuned(measured: DataFrame) -> DataFrame:
    """Thresholds of each language from the quartiles of its distinct texts; one row each, plus one for all ('*').

    Upper limits for line lengths, numeric density, alphanumerics and encoded
    runs, a lower one for white space. Bad files lie high, so the reach of the
    upper limits is the distance from the lower quartile to the median, of the
    files within WIDEST; the limit of encoded runs, which most files lack
    altogether, rises with the language's own upper quantile.
    """
    lines = (F.col("mean_line") <= WIDEST["mean_line"]) | (F.col("max_line") <= WIDEST["max_line"])
    within = {"mean_line": lines, "max_line": lines, "numeric": F.col("numeric") <= WIDEST["numeric"], "alnum": F.col("alnum") <= WIDEST["alnum"], "space": F.col("space") >= WIDEST["space"], "encoded": F.col("encoded") <= LOOSEST["encoded"]}
    at = lambda c: [ENCODED_AT] if c == "encoded" else [0.25, 0.5]
    quart = [F.percentile_approx(F.when(within[c], F.col(c)), at(c), 1000).alias(c) for c in TUNED]
    once = measured.where("n_chars > 0").select("lang", "text_key", *TUNED).dropDuplicates(["lang", "text_key"])
    both = once.withColumn("lang", F.explode(F.array("lang", F.lit("*"))))
    q = both.groupBy("lang").agg(F.count(F.lit(1)).alias("files"), *quart)
    room = lambda c: 1 - F.col(c)[1] if c == "alnum" else F.col(c)[1]
    far = lambda c: F.greatest(F.col(c)[1] - F.col(c)[0], room(c) * LEAST_SPREAD[c]) * REACH
    upper = [F.coalesce(F.least(F.greatest(F.col(c)[1] + far(c), F.lit(LOOSEST[c])), F.lit(WIDEST[c])), F.lit(LOOSEST[c])).alias(f"t_{c}") for c in _UPPER]
    lower = F.coalesce(F.least(F.greatest(F.col("space")[1] - far("space"), F.lit(WIDEST["space"])), F.lit(LOOSEST["space"])), F.lit(LOOSEST["space"])).alias("t_space")
    runs = F.least(F.coalesce(F.col("encoded")[0], F.lit(0.0)) + LOOSEST["encoded"], F.lit(WIDEST["encoded"])).alias("t_encoded")
    return q.select("lang", "files", *upper, lower, runs)


def vendor_folder(rel: F.Column) -> F.Column:
    """Names below the first folder of the vendor kind, without regard to case and separators; null if there is none."""
    bare = lambda x: F.regexp_replace(F.lower(x), r"[-_. ]", "")
    parts = F.split(F.lower(rel), r"[/\\]")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    kinds = F.array(*[F.lit(re.sub(r"[-_. ]", "", x)) for x in (*VENDOR_PATH_SEGMENTS, *VENDOR_FOLDERS)])
    first = F.array_position(F.transform(folders, lambda x: F.array_contains(kinds, bare(x))), True)
    return F.when(first > 0, F.slice(folders, first.cast("int") + 1, F.size(folders)))


def origins(files: DataFrame, commits: DataFrame) -> DataFrame:
    """One row per file_id with its evidence.

    ``files``: ``file_id, rel, text, first_commit`` and, where known, ``repo``;
    ``commits``: ``commit_sha, subject, n_files_added``. A file that comes in
    several rows counts as what any of its rows shows. Columns: ``file_id,
    lang``, the reasons ``generated, minified, data, vendor_path, bulk_import,
    vendor_commit, copied`` and ``not_hand_written``, their disjunction, never
    null. ``copied`` are files that say so and files with the code of one in a
    vendor folder, unless a folder below that one bears the name of their repo:
    then they are its source. Rows without file_id are left out; null texts,
    paths and commits show nothing; the language is the ending of the path in
    lower case, '' if there is none. Empty tables give an empty result. Other
    columns are ignored.
    """
    scratch = Scratch(files.sparkSession)
    lang = F.lower(F.regexp_extract(F.coalesce("rel", F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    below = vendor_folder(F.coalesce("rel", F.lit("")))
    name = F.lower(F.regexp_extract("repo", r"([^/]*)/*$", 1)) if "repo" in files.columns else F.lit(None).cast("string")
    kind = files.schema["file_id"].dataType.simpleString()
    rows = files.where("file_id is not null").select("file_id", "text", lang.alias("lang"), "first_commit", below.alias("below"), name.alias("repo_name"), F.xxhash64("text").alias("text_key"))
    fields = ", ".join(f"{c} double" for c in STATS)
    measured = scratch.cut(
        rows.mapInArrow(
            _measure,
            f"file_id {kind}, lang string, first_commit string, below array<string>, repo_name string, text_key bigint, {fields}, says_generated boolean, says_copied boolean, code_key bigint",
        ),
        "layout",
    )
    limits = scratch.cut(tuned(measured), "limits")
    rest = limits.where("lang = '*'").first()
    pooled = {c: F.lit(rest[f"t_{c}"] if rest else LOOSEST[c]) for c in TUNED}
    # blended by count, so that one more file never switches the limits of a language
    share = F.col("files") / (F.col("files") + LEAST_FILES)
    own = limits.where("lang <> '*'").select("lang", *[(share * F.col(f"t_{c}") + (1 - share) * pooled[c]).alias(f"t_{c}") for c in pooled])
    held = lookup_join(measured, own, ["lang"])
    t = {c: F.coalesce(F.col(f"t_{c}"), pooled[c]) for c in pooled}
    minified = (F.col("mean_line") > t["mean_line"]) & (F.col("max_line") > t["max_line"])
    data = (F.col("numeric") > t["numeric"]) | (F.col("encoded") > t["encoded"]) | ((F.col("space") < t["space"]) & (F.col("alnum") > t["alnum"]))
    told = (
        commits.where("commit_sha is not null")
        .groupBy(F.col("commit_sha").alias("first_commit"))
        .agg(F.max(F.col("n_files_added") >= BULK_IMPORT_FILES).alias("bulk_import"), F.max(F.col("subject").rlike(VENDOR_SUBJECT)).alias("vendor_commit"))
        .where("bulk_import or vendor_commit")
    )
    vendored = measured.where("code_key is not null and below is not null")
    copies = scratch.cut(vendored.select("code_key", F.lit(True).alias("as_vendored")).distinct(), "copies")
    sources = scratch.cut(vendored.select("code_key", F.explode("below").alias("repo_name"), F.lit(True).alias("is_source")).distinct(), "sources")
    seen = held.select(
        "file_id", "lang", "first_commit", "code_key", "repo_name", F.col("below").isNotNull().alias("vendor_path"), F.col("says_generated").alias("generated"), "says_copied", minified.alias("minified"), data.alias("data")
    )
    matched = lookup_join(lookup_join(seen, copies, ["code_key"]), sources, ["code_key", "repo_name"])
    full = lookup_join(matched, scratch.cut(told, "told"), ["first_commit"])
    full = full.withColumn("copied", F.col("says_copied") | (F.coalesce("as_vendored", F.lit(False)) & ~F.coalesce("is_source", F.lit(False)) & ~F.col("vendor_path")))
    reasons = ("generated", "minified", "data", "vendor_path", "bulk_import", "vendor_commit", "copied")
    one = full.groupBy("file_id").agg(F.max("lang").alias("lang"), *[F.coalesce(F.max(c), F.lit(False)).alias(c) for c in reasons])
    any_of = F.col(reasons[0])
    for c in reasons[1:]:
        any_of = any_of | F.col(c)
    return one.withColumn("not_hand_written", any_of)
