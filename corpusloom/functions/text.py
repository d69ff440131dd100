"""Column functions over texts: tokens, windows, cuts, snippets, dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.config import DEFAULT


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_tokens(query: str, least: int = 1) -> list[str]:
    """The same for a query, on the driver; repeats stay."""
    import regex

    return [t for t in regex.split(r"[^\p{L}\p{N}]+", query.lower()) if len(t) >= max(1, least)]


def graph_tokens(query: str) -> list[str]:
    """GRF-01: distinct in order; three characters for ASCII, two otherwise."""
    return [t for t in dict.fromkeys(query_tokens(query)) if len(t) >= (3 if t.isascii() else 2)]


def pieces(text: Column) -> Column:
    """Words with the white space after them."""
    return F.regexp_extract_all(text, F.lit(r"(?U)(\S+\s*)"), F.lit(1))


def windows(df: DataFrame, text: str = "text", size: int = DEFAULT.chunk_words, overlap: int = DEFAULT.chunk_overlap) -> DataFrame:
    """CHK-01: df with ord and chunk, a row for each window of words, verbatim; no row for a blank text."""
    step = max(1, size - overlap)
    own = df.withColumn("_p", pieces(F.coalesce(F.col(text), F.lit(""))))
    n = F.size("_p")
    count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / step).cast("int") + 1)
    texts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.regexp_replace(F.array_join(F.slice(F.col("_p"), i * step + 1, F.lit(size)), ""), r"(?U)\s+$", ""))
    return own.where(n > 0).select(*df.columns, F.posexplode(texts).alias("ord", "chunk"))


def head(text: Column, most: int = DEFAULT.head_bytes) -> Column:
    """CHK-02: the longest beginning of at most so many bytes that ends at a character."""
    raw = F.encode(text, "UTF-8")

    def inside(k: int) -> Column:
        return F.hex(F.substring(raw, most + 1 - k, 1)).between("80", "BF")

    cut = F.when(~inside(0), most).when(~inside(1), most - 1).when(~inside(2), most - 2).otherwise(most - 3)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.substring(raw, F.lit(1), cut), "UTF-8"))


def snippet(text: Column, most: int = 160) -> Column:
    """CHK-09: one line, with an ellipsis if it was cut."""
    line = F.translate(head(text, most), "\r\n", "  ")
    return F.when(F.octet_length(text) > most, F.concat(line, F.lit("…"))).otherwise(line)


def joined_chunks(df: DataFrame, key: str = "filepath") -> DataFrame:
    """CHK-04: the chunks of a file by ord, a line each; overlaps stay."""
    return df.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n").alias("text"))


def graph_blob(df: DataFrame, most: int = 6000) -> DataFrame:
    """CHK-05: the chunks of a file by chunk_id, each after a line end, until there are enough characters, cut there."""
    rows = F.sort_array(F.collect_list(F.struct("chunk_id", "text")))
    blob = F.aggregate(rows, F.lit(""), lambda a, x: F.when(F.length(a) >= most, a).otherwise(F.concat(a, F.lit("\n"), x["text"])))
    return df.groupBy("filepath").agg(F.substring(blob, 1, most).alias("blob"))


def weave(summary: Column, cells: Column) -> Column:
    """CHK-07: a sheet's summary over its cells; cells alone without one."""
    return F.when(F.coalesce(F.trim(summary), F.lit("")) == "", cells).otherwise(F.concat_ws("\n", summary, cells))


def content_key(*parts: Column) -> Column:
    """CHK-08."""
    return F.sha2(F.concat_ws("\0", *parts), 256)


def line_range(file: Column, chunk: Column) -> Column:
    """CHK-10: first and last line of a verbatim chunk in its file; white space is forgiven if it isn't verbatim."""
    at = F.instr(file, chunk)

    def lines(text: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))

    first = lines(F.substring(file, F.lit(1), at - 1)) + 1
    exact = F.struct(first.cast("long").alias("first"), (first + lines(F.rtrim(chunk, F.lit("\n")))).cast("long").alias("last"))
    # otherwise: a word of the file is a line number and the word, and the chunk's words are looked for in a row
    words = F.flatten(F.transform(F.split(file, "\n"), lambda line, i: F.transform(F.filter(F.split(line, r"\s+"), lambda w: w != ""), lambda w: F.struct((i + 1).alias("line"), w.alias("w")))))
    wanted = F.filter(F.split(chunk, r"\s+"), lambda w: w != "")
    plain = F.concat(F.lit(" "), F.array_join(F.transform(words, lambda x: x["w"]), " "), F.lit(" "))
    spot = F.instr(plain, F.concat(F.lit(" "), F.array_join(wanted, " "), F.lit(" ")))
    before = F.substring(plain, F.lit(1), spot)
    index = F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit("")))
    loose = F.when((spot > 0) & (F.size(wanted) > 0), F.struct(F.element_at(words, index)["line"].cast("long").alias("first"), F.element_at(words, index + F.size(wanted) - 1)["line"].cast("long").alias("last")))
    return F.when((at > 0) & (chunk != ""), exact).otherwise(loose)


def preserves_facts(original: Column, compressed: Column, share: float = 0.9) -> tuple[Column, Column]:
    """CUR-19: whether numbers (most), urls and code spans (all) are kept, and the share of numbers."""
    def found(pattern: str, group: int) -> Column:
        return F.array_distinct(F.regexp_extract_all(original, F.lit(pattern), F.lit(group)))

    numbers = found(r"\d[\d,]*\.?\d*%?", 0)
    kept = F.filter(numbers, lambda x: F.contains(compressed, x))
    ratio = F.when(F.size(numbers) == 0, F.lit(1.0)).otherwise(F.size(kept) / F.size(numbers))
    every = F.forall(found(r"https?://\S+", 0), lambda x: F.contains(compressed, x)) & F.forall(found(r"`([^`]+)`", 1), lambda x: F.contains(compressed, x))
    return (ratio >= share) & every, F.round(ratio, 3)


def subsequence_share(original: Column, compressed: Column) -> Column:
    """CUR-20: words of the compressed text met in order in the original; once one isn't, nothing later is."""
    def words(text: Column) -> Column:
        return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), F.lit(1))

    o, c = words(original), words(compressed)
    start = F.struct(o.alias("left"), F.lit(0).alias("met"))

    def step(a: Column, w: Column) -> Column:
        at = F.array_position(a["left"], w)
        rest = F.when(at > 0, F.slice(a["left"], at.cast("int") + 1, F.size(a["left"]))).otherwise(F.array().cast("array<string>"))
        return F.struct(rest.alias("left"), (a["met"] + (at > 0).cast("int")).alias("met"))

    return F.when(F.size(c) == 0, F.lit(0.0)).otherwise(F.round(F.aggregate(c, start, step)["met"] / F.size(c), 3))


def refused(reply: Column) -> Column:
    """SRC-10: the text of a transcription reply; null if it is empty or opens with a refusal."""
    text = F.trim(reply, F.lit(" \t\r\n"))
    opening = F.lower(F.substring(text, 1, 64))
    hit = F.lit(False)
    for phrase in REFUSALS:
        hit = hit | F.contains(opening, F.lit(phrase))
    return F.when((text != "") & ~hit, text)


#: How refusals open.
REFUSALS = ["sorry", "i'm sorry", "i am sorry", "i can't", "i cannot", "i can not", "i'm unable", "i am unable", "i'm not able", "unable to transcribe", "can't transcribe", "cannot transcribe", "the document contains no text", "[the document contains no text", "there is no text", "contains no text"]
VISION_REFUSALS = ["sorry", "i can't", "i cannot", "i can not", "i'm unable", "i am unable", "i'm not able"]


def vision_reply(reply: Column, sentinel: str = "[VISUAL]") -> Column:
    """SRC-10: (text, is_description) of a merged vision reply; null if it is empty or refuses."""
    text = F.trim(reply, F.lit(" \t\r\n"))
    told = F.trim(F.substring(text, F.lit(len(sentinel) + 1), F.length(text)), F.lit(" \t\r\n"))
    opening = F.lower(F.substring(text, 1, 32))
    hit = F.lit(False)
    for phrase in VISION_REFUSALS:
        hit = hit | F.contains(opening, F.lit(phrase))
    described = F.struct(told.alias("text"), F.lit(True).alias("is_description"))
    plain = F.struct(text.alias("text"), F.lit(False).alias("is_description"))
    return F.when(text == "", None).when(F.startswith(text, F.lit(sentinel)), F.when(told != "", described)).when(~hit, plain)


def iso_millis(text: Column) -> Column:
    """ISO-8601 to epoch milliseconds; the offset is ignored, the fraction cut or filled to three digits."""
    second = F.unix_timestamp(F.to_timestamp(F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})", 1), "yyyy-MM-dd'T'HH:mm:ss"))
    fraction = F.rpad(F.substring(F.regexp_extract(text, r"\.(\d+)", 1), 1, 3), 3, "0").cast("long")
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"), second * 1000 + fraction)


def slug(name: Column) -> Column:
    """GRF-29: lower-cased runs of ASCII letters and digits joined by -; a hash where there are none."""
    plain = F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(plain != "", plain).otherwise(F.concat(F.lit("e-"), fnv_hex(name)))


@F.pandas_udf(T.StringType())
def fnv_hex(names):
    """FNV-1a of 64 bits, as 16 hexadecimal digits."""
    return names.map(lambda x: None if x is None else f"{fnv1a(x.encode()):016x}")


def fnv1a(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def stitch(texts: list[str], most_overlap: int = DEFAULT.stitch_overlap, cap: int = DEFAULT.stitch_cap) -> str:
    """CHK-03: consecutive chunks as one text, the largest overlap dropped, at most so many bytes."""
    out = b""
    for text in texts:
        if len(out) >= cap:
            break
        raw = text.encode()
        n = min(len(out), len(raw), most_overlap)
        while n and not (out.endswith(raw[:n]) and (n == len(raw) or raw[n] & 0xC0 != 0x80)):
            n -= 1
        out += raw[n:]
    return out[:cap].decode("utf-8", "ignore")


def stitched(chunks: DataFrame, cap: int = DEFAULT.stitch_cap) -> DataFrame:
    """CHK-03 for each file: the chunks by ord. A file's chunks are gathered by the JVM and read by an Arrow UDF."""
    @F.pandas_udf(T.StringType())
    def whole(lists):
        return lists.map(lambda x: stitch(list(x), cap=cap))

    rows = chunks.groupBy("filepath").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias("parts"))
    return rows.select("filepath", whole("parts").alias("text"))


def packed_paragraphs(df: DataFrame, text: str = "text", most: int = 1500) -> DataFrame:
    """CHK-06: paragraphs packed greedily to so many tokens (here words); a longer one is cut after what is pending."""
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def pack(texts):
        def one(value):
            out, held, size = [], [], 0
            for p in (value or "").split("\n\n"):
                words = p.split()
                if not words:
                    continue
                if held and size + len(words) > most:
                    out.append("\n\n".join(held))
                    held, size = [], 0
                if len(words) > most:
                    out += [" ".join(words[i : i + most]) for i in range(0, len(words), most)]
                else:
                    held.append(p)
                    size += len(words)
            return [*out, "\n\n".join(held)] if held else out

        return texts.map(one)

    return df.select(*[c for c in df.columns if c != text], F.posexplode(pack(F.col(text))).alias("ord", "passage"))
