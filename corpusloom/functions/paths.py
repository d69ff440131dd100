"""Column functions over paths, names and file modes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of the code lane.
CODE_LANE = "rs py ts tsx js jsx mjs cjs go java kt kts scala c h cc cpp cxx hpp hh rb php swift m mm sh bash zsh sql lua r jl pl pm ex exs erl clj cljs hs ml fs dart vue svelte proto tf".split()
#: Extensions by file type of a graph node.
TYPE_CODE = "py ts tsx js jsx go rs java c cpp h rb php swift kt scala sh".split()
TYPE_IMAGE = "png jpg jpeg webp gif bmp svg".split()
#: Names that operating systems leave about.
NOISE_ROOTS = [".Spotlight-V100", ".Trashes", ".fseventsd", ".TemporaryItems"]
NOISE_NAMES = [".DS_Store", ".localized", ".apdisk", ".VolumeIcon.icns", ".metadata_never_index", ".metadata_never_index_unless_rootfs", ".com.apple.timemachine.donotpresent", "Icon\r"]
#: Kinds of file that are inlined, kept verbatim, or never compressed.
BINARY = "xlsx xls pdf docx pptx ppt doc".split()
SPREADSHEET = "xlsx xls xlsm csv tsv".split()
VERBATIM = "rs py js mjs cjs ts tsx jsx go java c h cpp cc hpp cs rb php sh bash zsh sql swift kt scala lua pl r dart ex exs clj hs ml vue svelte toml yaml yml json xml html htm css scss".split()
EXTRACTED = ".extracted.md"
#: Derived siblings that go with their source, but for the sync-error file, whose name is ours.
SIBLINGS = [".image-transcription.md", ".pdf-transcription.md", ".video-transcription.md", ".audio-transcription.md", ".webpage-transcription.md", ".sync-error.txt", EXTRACTED]
#: Error pages. The first that is found names the error.
ERROR_MARKS = [("403 forbidden", "403 Forbidden"), ("404 not found", "404 Not Found"), ("502 bad gateway", "502 Bad Gateway"), ("openresty", "HTTP error")]


def in_scope(path: Column, prefix: str | None) -> Column:
    """FIL-01: a literal prefix, which reaches the scan; no prefix is no scope."""
    return F.lit(True) if not prefix else F.startswith(path, F.lit(prefix))


def scope_of(target: str, mount: str = "") -> str | None:
    """FIL-02: the scope that a path argument means; the root is none."""
    if mount and (target == mount or target.startswith(mount.rstrip("/") + "/")):
        target = target[len(mount.rstrip("/")) :]
    parts = [p for p in target.split("/") if p not in ("", ".")]
    if not parts:
        return None
    return "/" + "/".join(parts) + ("" if "." in parts[-1] else "/")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_code(path: Column) -> Column:
    """FIL-03: goes to the code lane."""
    base = base_name(path)
    return F.contains(base, F.lit(".")) & F.lower(F.substring_index(base, ".", -1)).isin(CODE_LANE)


def in_output(path: Column, folder: str = "model_output") -> Column:
    """FIL-04."""
    bare = F.ltrim(path, F.lit("/"))
    return (bare == folder) | F.startswith(bare, F.lit(folder + "/"))


def is_digest(path: Column) -> Column:
    """FIL-05."""
    return path == "/KNOWLEDGE_GRAPH.md"


def is_error_page(text: Column, in_bytes: bool = True) -> Column:
    """FIL-06: a short html page that says an error. Its length counts bytes in annotations, characters in the lane."""
    body = F.lower(F.regexp_replace(text, r"^\s+", ""))
    size = F.octet_length(text) if in_bytes else F.length(text)
    hit = F.lit(False)
    for mark, _ in ERROR_MARKS:
        hit = hit | F.contains(body, F.lit(mark))
    return F.coalesce(F.startswith(body, F.lit("<html")) & (size < 2048) & hit, F.lit(False))


def error_label(text: Column) -> Column:
    """FIL-06: the status in order of priority; null if the text is no error page."""
    body, label = F.lower(text), None
    for mark, name in ERROR_MARKS:
        label = F.when(F.contains(body, F.lit(mark)), name) if label is None else label.when(F.contains(body, F.lit(mark)), name)
    return F.when(is_error_page(text), label)


def is_noise(path: Column) -> Column:
    """FIL-07."""
    bare = F.ltrim(path, F.lit("/"))
    first, base = F.substring_index(bare, "/", 1), base_name(bare)
    rooted = F.lit(False)
    for name in NOISE_ROOTS:
        rooted = rooted | F.startswith(first, F.lit(name))
    return (bare != "") & (rooted | F.startswith(base, F.lit("._")) | base.isin(NOISE_NAMES))


def _source_extension(path: Column) -> Column:
    lower = F.lower(path)
    bare = F.when(F.endswith(lower, F.lit(EXTRACTED)), F.substring(lower, F.lit(1), F.length(lower) - len(EXTRACTED))).otherwise(lower)
    return F.when(F.contains(bare, F.lit(".")), F.substring_index(bare, ".", -1)).otherwise("")


def is_binary(path: Column) -> Column:
    """FIL-08."""
    return F.lower(F.substring_index(path, ".", -1)).isin(BINARY)


def is_spreadsheet(path: Column) -> Column:
    """FIL-08, seen through the extracted sibling's suffix."""
    return _source_extension(path).isin(SPREADSHEET)


def is_verbatim(path: Column) -> Column:
    """FIL-08: code and structured text, never compressed."""
    return _source_extension(path).isin(VERBATIM)


def normalised(path: Column) -> Column:
    """FIL-09: one /, no ., .. popped; null if it leaves the root, holds a NUL, or a name or it is too long."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    none = F.array().cast("array<string>")
    stack = F.aggregate(parts, F.struct(none.alias("s"), F.lit(True).alias("ok")), lambda a, p: F.when(p == "..", F.struct(F.slice(a["s"], F.lit(1), F.greatest(F.size(a["s"]) - 1, F.lit(0))).alias("s"), (a["ok"] & (F.size(a["s"]) > 0)).alias("ok"))).otherwise(F.struct(F.concat(a["s"], F.array(p)).alias("s"), a["ok"].alias("ok"))))
    out = F.concat(F.lit("/"), F.array_join(stack["s"], "/"))
    fits = (F.octet_length(out) <= 4096) & F.forall(stack["s"], lambda p: F.octet_length(p) <= 255) & ~F.contains(path, F.lit("\0"))
    return F.when(stack["ok"] & fits, out)


def parent(path: Column) -> Column:
    cut = F.regexp_replace(path, r"/[^/]*$", "")
    return F.when(cut == "", "/").otherwise(cut)


def top_dir(path: Column) -> Column:
    """FIL-10: the first folder of a path, / for a file at the root."""
    return F.when(F.regexp_extract(path, r"^/?([^/]+)/", 1) == "", "/").otherwise(F.concat(F.lit("/"), F.regexp_extract(path, r"^/?([^/]+)/", 1)))


def slug_of(entity_path: Column) -> Column:
    """FIL-10: the name in an entity's path."""
    return F.regexp_replace(base_name(entity_path), r"\.md$", "")


def file_type(path: Column) -> Column:
    """FIL-11."""
    ext = F.lower(F.substring_index(path, ".", -1))
    return F.when(ext.isin(TYPE_CODE), "code").when(ext == "pdf", "paper").when(ext.isin(TYPE_IMAGE), "image").otherwise("document")


def flag(value: str | None, default: bool = False) -> bool:
    """FIL-12: on by a truthy word where off is the default, off by a falsy word where on is."""
    word = (value or "").strip().lower()
    return word not in ("0", "off", "false", "no") if default else word in ("1", "on", "true", "yes")


def good_entity(name: Column) -> Column:
    """FIL-13."""
    n = F.trim(name)
    return F.coalesce(F.length(n).between(2, 30) & ~n.rlike(r"^\d{4}[-/.]\d{1,2}([-/.]\d{1,2})?$") & ~n.rlike(r"^[\d.,%¥$€\s-]+$") & n.rlike("[A-Za-z一-鿿]"), F.lit(False))


def is_regular(mode: Column) -> Column:
    """FIL-15."""
    return mode.bitwiseAND(F.lit(61440)) == 32768


def is_directory(mode: Column) -> Column:
    return mode.bitwiseAND(F.lit(61440)) == 16384


def is_symlink(mode: Column) -> Column:
    return mode.bitwiseAND(F.lit(61440)) == 40960


def last_ident(name: Column) -> Column:
    """GRF-35: the last part of a dotted or :: name."""
    return F.regexp_extract(name, r"([^.:]*)$", 1)


def module_of(path: Column) -> Column:
    """GRF-35: a file's module name."""
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")
