"""Text cleaning as column expressions (B1-B9) and the tokeniser (F1)."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space as the corpus tools understand it (Unicode spaces
# and the ASCII separators), spelled out because Java's \s differs.
WS = r"\t-\r\x1c-\x20\x85\xa0  -     　"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
# The same white space as a string, and as a class that a letter leaves after three tests.
WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
RARE_WS = r"[\x85-　&&[\x85\xa0  -     　]]"
WS_TEST = rf"[\t-\r\x1c-\x20{RARE_WS}]"
CJK = r"一-鿿"

# Characters that betray UTF-8 read as GBK, and frequent words of clean text.
CORE_MOJIBAKE = "锛绗鏉閲鐩瀹彂€"
GATE_MARKERS = CORE_MOJIBAKE + "锛鈥鐨骞鏈鍙鎵涓瀹绗妯"
CORE_COMMON = ("的", "第", "公司", "发行", "债券", "信息", "报告")
INDEX_COMMON = CORE_COMMON + ("保险", "年度", "募集")


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col: Column | str, chars: str = WS) -> Column:
    """Trim a character class (regex class body) from both ends."""
    if chars == WS:
        return F.btrim(_c(col), F.lit(WS_CHARS))
    return F.regexp_replace(_c(col), f"^[{chars}]+|[{chars}]+$", "")


def rstrip(col: Column | str, chars: str = WS) -> Column:
    return F.regexp_replace(_c(col), f"[{chars}]+$", "")


def falsy_null(col: Column | str) -> Column:
    """Empty text counts as missing."""
    if isinstance(col, str):
        return F.nullif(F.col(col), F.lit(""))
    return let(col, lambda c: F.when(c != "", c))


def lines(col: Column | str) -> Column:
    return F.split(_c(col), LINE_END)


def squeeze(col: Column | str) -> Column:
    """B3 without repair: runs of white space become one blank; single blanks are passed over."""
    return F.trim(F.regexp_replace(_c(col), rf"{WS_TEST}{{2,}}|[\t-\r\x1c-\x1f{RARE_WS}]", " "))


def compact_text(col: Column | str) -> Column:
    """Repair, then squeeze."""
    return squeeze(repair(F.coalesce(_c(col), F.lit(""))))


# --- B1 -------------------------------------------------------------------


def one_of(chars: str) -> str:
    """Regex class of single characters, halved by ranges: a character is tested against few of them, not against all in turn."""
    chars = "".join(sorted(set(chars)))
    if len(chars) <= 3:
        return f"[{chars}]"
    left, right = chars[: len(chars) // 2], chars[len(chars) // 2 :]
    return f"[[{left[0]}-{left[-1]}&&{one_of(left)}][{right[0]}-{right[-1]}&&{one_of(right)}]]"


def _is_wide(col: Column) -> Column:
    """Whether a text has any character beyond ASCII, by two lengths and without a regex."""
    return F.octet_length(col) > F.length(col)


def _count(col: Column, pattern: str) -> Column:
    return F.regexp_count(col, F.lit(pattern))


def _balance(col: Column, common: tuple[str, ...], markers: str, weight: int) -> Column:
    first = one_of("".join(word[0] for word in common))  # the words are tried only where one may begin
    return _count(col, f"(?={first})(?:{'|'.join(common)})") * weight - _count(col, one_of(markers))


def _reencode(col: Column, lossy: bool) -> Column:
    """Bytes of the GB18030 form read as UTF-8; NULL (strict) or repaired (lossy) when invalid."""
    raw = F.encode(col, "GB18030").cast("string")
    return without_invalid(raw) if lossy else F.try_validate_utf8(raw)


def without_invalid(raw: Column) -> Column:
    """Valid UTF-8 of a string's bytes: undecodable ones are left out, a replacement character that stands there stays."""
    kept = F.replace(raw, F.lit("\ufffd"), F.lit("\ue0f0\ufdd0\ue0f1"))  # holds a noncharacter, which no text has
    return F.replace(F.replace(F.make_valid_utf8(kept), F.lit("\ufffd"), F.lit("")), F.lit("\ue0f0\ufdd0\ue0f1"), F.lit("\ufffd"))


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``fn``; keeps nested rules from copying their input."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def power_of_two(k: Column) -> Column:
    return F.pow(F.lit(2), k).cast("int")


def running_sums(numbers: Column) -> Column:
    """Sum up to each element of an array of longs, itself included: prefix sums by doubling, n log n steps."""
    steps = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(F.size(numbers))).cast("int"), F.lit(1)))

    def add(acc: Column, k: Column) -> Column:
        return F.transform(acc, lambda x, i: x + F.when(i >= power_of_two(k), F.get(acc, i - power_of_two(k))).otherwise(0))

    return F.aggregate(steps, numbers, add)


def repair(
    col: Column | str,
    variant: str = "core",
    markers: str | None = None,
    common: tuple[str, ...] | None = None,
) -> Column:
    """B1: undo UTF-8 text that was decoded as GBK.

    ``core``    only rows with a marker, strict re-decoding, better score wins.
    ``index``   every row, strict then lossy re-decoding, better score wins.
    ``dataset`` marker rows, lossy; fewer markers, then more CJK characters win.
    ``eval``    core first, then marker rows, lossy if needed; ties take the repaired text.

    A cheap pattern test comes first, so clean rows are never re-encoded.
    """
    if variant == "core":
        markers, common = markers or CORE_MOJIBAKE, common or CORE_COMMON
        gate = one_of(GATE_MARKERS)

        def best(c: Column, fixed: Column) -> Column:
            return F.when(_balance(fixed, common, markers, 3) > _balance(c, common, markers, 3), fixed).otherwise(c)

        strict, lossy = True, False
    elif variant == "index":
        markers, common = markers or CORE_MOJIBAKE + "�", common or INDEX_COMMON
        gate = r"[^\x00-\x7f]"  # ASCII re-decodes to itself

        def best(c: Column, fixed: Column) -> Column:
            return F.when(_balance(fixed, common, markers, 3) > _balance(c, common, markers, 3), fixed).otherwise(c)

        strict, lossy = True, True
    elif variant == "dataset":
        markers = markers or GATE_MARKERS
        gate = f"[{markers}]"

        def best(c: Column, fixed: Column) -> Column:
            bad, left = _count(c, gate), _count(fixed, gate)
            more = _count(fixed, f"[{CJK}]") > _count(c, f"[{CJK}]")
            return F.when((fixed != "") & ((left < bad) | ((left == bad) & more)), fixed).otherwise(c)

        strict, lossy = False, True
    elif variant == "eval":
        markers, common = markers or GATE_MARKERS, common or CORE_COMMON
        col = repair(col)
        gate = f"[{markers}]"

        def best(c: Column, fixed: Column) -> Column:
            return F.when(_balance(fixed, common, markers, 4) >= _balance(c, common, markers, 4), fixed).otherwise(c)

        strict, lossy = True, True
    else:
        raise ValueError(f"unknown repair variant {variant}")

    def fix(c: Column) -> Column:
        forms = [_reencode(c, False)] * strict + [_reencode(c, True)] * lossy
        return F.coalesce(let(F.coalesce(*forms), lambda fixed: best(c, fixed)), c)

    ascii_safe = not set(markers).intersection(map(chr, range(128)))

    def gated(c: Column) -> Column:
        return F.when(_is_wide(c) & c.rlike(gate) if ascii_safe else c.rlike(gate), fix(c)).otherwise(c)

    return gated(F.col(col)) if isinstance(col, str) else let(col, gated)


def repair_nested(df: DataFrame, variant: str = "core", keys: bool = False) -> DataFrame:
    """Repair every string inside arrays, maps and structs, driven by the schema."""

    def walk(col: Column, dtype: T.DataType) -> Column:
        if isinstance(dtype, T.StringType):
            return repair(col, variant)
        if isinstance(dtype, T.ArrayType):
            return F.transform(col, lambda x: walk(x, dtype.elementType))
        if isinstance(dtype, T.MapType):
            out = F.transform_values(col, lambda k, v: walk(v, dtype.valueType))
            if keys and isinstance(dtype.keyType, T.StringType):
                out = F.transform_keys(out, lambda k, v: repair(k, variant))
            return out
        if isinstance(dtype, T.StructType):
            fields = [walk(col.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
            return F.when(col.isNotNull(), F.struct(*fields))
        return col

    return df.select(*[walk(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


# --- B2, B4 ---------------------------------------------------------------


def normalize_text(col: Column | str, fix: bool = True) -> Column:
    """B2: drop comments, BOM and images, unwrap details, squeeze blank lines, strip."""
    c = _c(col)
    if fix:
        c = repair(c, "index")
    c = _where("<!--", c, lambda x: F.regexp_replace(x, r"(?s)<!--.*?-->", ""))
    c = F.replace(c, F.lit("\ufeff"), F.lit(""))
    c = _where("<", c, _unwrap_details)
    c = F.regexp_replace(c, r"\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", "\n")  # LINE_END but for plain line feeds
    c = _where("![", c, lambda x: F.regexp_replace(x, r"!\[[^\]\n]*\]\([^)\n]+\)", ""))
    c = F.regexp_replace(c, rf"(?m)[\t\x0b-\r\x1c-\x20{RARE_WS}]++$", "")
    c = _where("\n\n\n", c, lambda x: F.regexp_replace(x, r"\n{3,}", "\n\n"))
    return strip(c)


def _where(mark: str, col: Column, rule: Callable[[Column], Column]) -> Column:
    """Apply a rule only to texts that hold the string it cannot do without."""
    return let(col, lambda c: F.when(F.contains(c, F.lit(mark)), rule(c)).otherwise(c))


def _unwrap_details(c: Column) -> Column:
    # One split per details element: the odd parts hold "summary \x01 body".
    marked = F.regexp_replace(
        c,
        f"(?is)<details>[{WS}]*<summary>[{WS}]*(.*?)[{WS}]*</summary>[{WS}]*(.*?)</details>",
        "\x02$1\x01$2\x02",
    )

    def part(x: Column, i: Column) -> Column:
        summary = squeeze(F.substring_index(x, "\x01", 1))
        body = strip(F.substring_index(x, "\x01", -1))
        label = F.when(summary != "", F.concat(F.lit("[details: "), summary, F.lit("]\n"))).otherwise("")
        return F.when(i % 2 == 1, F.concat(F.lit("\n\n"), label, body, F.lit("\n"))).otherwise(x)

    return let(
        marked,
        lambda m: F.when(
            F.contains(m, F.lit("\x02")), F.array_join(F.transform(F.split(m, "\x02"), part), "")
        ).otherwise(m),
    )


def unescape(col: Column) -> Column:
    """Character references as HTML 5 reads them, in one pass: any name, decimal and hexadecimal numbers.

    The names come from Python's public table; old names also count without
    their semicolon, the longest first. Numbers of no character give U+FFFD,
    controls and noncharacters nothing, and 128 to 159 are read as Windows-1252.
    """
    table = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    old = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))

    def number(code: Column) -> Column:
        wide = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        cp1252 = F.decode(F.unhex(F.lpad(F.hex(code), 2, "0")), "windows-1252")
        wrong = code.isNull() | (code <= 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        control = code.between(1, 8) | code.between(14, 31) | code.isin(11, 127) | code.between(0xFDD0, 0xFDEF) | (F.pmod(code, F.lit(0x10000)) >= 0xFFFE)
        old_page = code.between(128, 159) & ~code.isin(129, 141, 143, 144, 157)
        return F.when(wrong, "\ufffd").when(control, "").when(old_page, cp1252).otherwise(wide)

    def piece(p: Column, i: Column) -> Column:
        dec, hexa = F.regexp_extract(p, "^#[0-9]+;?", 0), F.regexp_extract(p, "^#[xX][0-9a-fA-F]+;?", 0)
        full, short = F.regexp_extract(p, "^[A-Za-z][A-Za-z0-9]*;", 0), F.regexp_extract(p, f"^(?:{old})", 0)
        rest = lambda found: F.substring(p, F.length(found) + 1, F.length(p))
        digits = lambda found: F.regexp_replace(found, "[#xX;]", "")
        return (
            F.when(i == 0, p)
            .when(hexa != "", F.concat(number(F.conv(F.right(digits(hexa), F.lit(9)), 16, 10).cast("bigint")), rest(hexa)))
            .when(dec != "", F.concat(number(digits(dec).try_cast("bigint")), rest(dec)))
            .when((full != "") & F.map_contains_key(table, full), F.concat(F.element_at(table, full), rest(full)))
            .when(short != "", F.concat(F.element_at(table, short), rest(short)))
            .otherwise(F.concat(F.lit("&"), p))
        )

    return F.when(F.contains(col, F.lit("&")), F.array_join(F.transform(F.split(col, "&", -1), piece), "")).otherwise(col)


def html_text(col: Column | str) -> Column:
    """Markup to text lines; cells are parted by `` | ``; plain text stays as it is."""
    return let(_c(col), lambda c: F.when(F.contains(c, F.lit("<")) & F.contains(c, F.lit(">")), _markup_text(c)).otherwise(c))


def _markup_text(c: Column) -> Column:
    # script and style bodies are character data, so their "<" opens no tag
    t = F.regexp_replace(c, r"(?is)(<(script|style)\b[^>]*>)(.*?)(</\2\s*>)", "$1\x05$3\x05$4")
    t = F.array_join(
        F.transform(
            F.split(t, "\x05"),
            lambda x, i: F.when(i % 2 == 1, F.replace(x, F.lit("<"), F.lit("\x04"))).otherwise(x),
        ),
        "",
    )
    t = F.regexp_replace(t, r"(?s)<!--.*?-->|<![^>]*>", "")
    t = F.regexp_replace(t, r"(?i)</?(?:tr|p|div|h[1-4]|li)(?:\s[^>]*)?/?>|<br(?:\s[^>]*)?/?>", "\x01")
    t = F.regexp_replace(t, r"(?i)</?(?:td|th)(?:\s[^>]*)?/?>", "\x02")
    # every remaining tag ends a run of character data, whose edges are stripped
    t = F.regexp_replace(t, r"</?[A-Za-z][^>]*>", "\x03")
    t = unescape(F.replace(t, F.lit("\x04"), F.lit("<")))
    t = F.regexp_replace(t, f"[{WS}]*([\x01\x02\x03])[{WS}]*", "$1")
    t = F.replace(F.replace(t, F.lit("\x03"), F.lit("")), F.lit("\x01"), F.lit("\n"))
    t = F.replace(t, F.lit("\x02"), F.lit(" | "))
    t = F.regexp_replace(t, r"[ \t]*\|[ \t]*", " | ")
    t = F.regexp_replace(t, r"(?:[ \t]*\|[ \t]*){2,}", " | ")
    kept = F.filter(
        F.transform(lines(t), lambda x: strip(F.regexp_replace(x, f"[{WS}]+", " "), " |")), lambda x: x != ""
    )
    return let(strip(F.array_join(kept, "\n")), lambda out: F.when(out == "", c).otherwise(out))


# --- B5, B6, B8, B9 -------------------------------------------------------


def clip(col: Column | str, n: int, style: str = "ellipsis") -> Column:
    """``ellipsis`` cuts at n-3 and adds dots, ``suffix`` adds dots after n, ``prefix`` just cuts."""
    c = squeeze(F.coalesce(_c(col), F.lit("")))
    if style == "ellipsis":
        # squeezed text has single blanks, so at most one is stripped before the dots
        return F.regexp_replace(c, f"(?s)^(?:(.{{{n - 4}}}[^ ])|(.{{{n - 4}}}) ).{{4,}}$", "$1$2...")
    if style == "suffix":
        return F.regexp_replace(c, f"(?s)^(.{{{n}}}).+$", "$1...")
    if style == "prefix":
        return F.substring(c, 1, n)
    raise ValueError(f"unknown clip style {style}")


# The characters each kind of match key drops (regex class bodies).
KEY_DROPS = {
    "heading": WS + "，,。；;：:、.．（）()《》<>【】\\[\\]\"'“”‘’",
    "catalog": WS + "、，,。；;：:（）()\\[\\]【】《》\"'“”‘’/\\\\_\\-",
    "reference": WS + ":：,，。；;()（）",
    "intent": WS + ",.;:!?、，。；：！？",
}


def match_key(col: Column | str, kind: str = "heading") -> Column:
    """Text reduced to what counts when two labels are compared."""
    c = F.coalesce(_c(col), F.lit(""))
    if kind == "slot":
        return F.regexp_replace(F.lower(repair(c)), r"(?U)[\W_]+", "")
    if kind == "reference":
        return F.regexp_replace(F.translate(repair(c), "ＡＢＣＤ", "ABCD"), f"[{KEY_DROPS[kind]}]+", "")
    if kind == "heading":
        c = repair(c)
    return F.lower(F.regexp_replace(c, f"[{KEY_DROPS[kind]}]+", ""))


def stable_id(col: Column | str, n: int = 10) -> Column:
    """md5 prefix."""
    return F.substring(F.md5(_c(col).cast("binary")), 1, n)


def query_id(col: Column | str) -> Column:
    """Readable query id with a short digest."""
    c = _c(col)
    surface = F.substring(strip(F.regexp_replace(c, r"(?U)\W+", "_"), "_"), 1, 24)
    return F.concat_ws("_", F.lit("chat"), falsy_null(surface), stable_id(c, 8))


LIST_TRIM = r" \t\r\n,，。；;：:"


def unique_compact(arr: Column | str, n: int, trim: str = LIST_TRIM, variant: str | None = "index") -> Column:
    """Squeezed, trimmed, non-empty values in first-seen order, at most n."""

    def clean(x: Column) -> Column:
        x = F.coalesce(x, F.lit(""))
        x = repair(x, variant) if variant else x
        return strip(F.regexp_replace(x, f"[{WS}]+", " "), trim)

    return F.slice(F.array_distinct(F.filter(F.transform(_c(arr), clean), lambda x: x != "")), 1, n)


def clean_list(arr: Column | str, n: int = 8, max_chars: int = 80) -> Column:
    """B9, chat form: every value clipped, empty ones dropped, at most n."""
    return F.slice(F.array_distinct(F.filter(F.transform(_c(arr), lambda x: clip(x, max_chars)), lambda x: x != "")), 1, n)


# --- F1 -------------------------------------------------------------------


def _ngrams(run: Column, n: int) -> Column:
    return F.transform(
        F.sequence(F.lit(1), F.length(run) - (n - 1)), lambda i: F.substring(run, i, F.lit(n))
    )


def tokenize(col: Column | str, fix: bool = True) -> Column:
    """lower-case latin words, CJK runs, and the 2- and 3-grams of runs of four or more."""

    def tokens(c: Column) -> Column:
        words = F.regexp_extract_all(F.lower(c), F.lit(r"[A-Za-z0-9_.%-]+"), F.lit(0))

        def wide(runs: Column) -> Column:
            long_runs = F.filter(runs, lambda r: F.length(r) >= 4)
            return F.concat(runs, F.flatten(F.transform(long_runs, lambda r: F.concat(_ngrams(r, 2), _ngrams(r, 3)))))

        # latin text has no runs, so the n-gram branch is skipped row by row
        runs = F.regexp_extract_all(c, F.lit(f"[{CJK}]{{2,}}"), F.lit(0))
        return F.when(c.rlike(f"[{CJK}]{{2}}"), F.concat(words, let(runs, wide))).otherwise(words)

    c = F.coalesce(_c(col), F.lit(""))
    return let(repair(c) if fix else c, tokens)


def token_set(col: Column | str, fix: bool = True) -> Column:
    return F.array_distinct(tokenize(col, fix))


def overlap(a: Column, b: Column) -> Column:
    """Number of shared distinct tokens."""
    return F.size(F.array_intersect(a, b))


def overlap_with_text(tokens: Column, col: Column | str) -> Column:
    """``overlap(tokens, token_set(col))`` of distinct tokens, without the n-grams of the text: those of a long run are its substrings."""
    return let(text_parts(col), lambda parts: overlap_with_parts(tokens, parts))


def text_parts(col: Column | str) -> Column:
    """What :func:`overlap_with_parts` needs of a text: its words and runs, and the long runs as one string."""

    def cut(c: Column) -> Column:
        words = F.regexp_extract_all(F.lower(c), F.lit(r"[A-Za-z0-9_.%-]+"), F.lit(0))
        joined = lambda runs: F.array_join(F.filter(runs, lambda r: F.length(r) >= 4), "\n")
        return let(F.regexp_extract_all(c, F.lit(f"[{CJK}]{{2,}}"), F.lit(0)), lambda runs: F.struct(F.concat(words, runs).alias("whole"), joined(runs).alias("long")))

    return let(repair(F.coalesce(_c(col), F.lit(""))), cut)


def overlap_with_parts(tokens: Column, parts: Column) -> Column:
    """Number of distinct tokens that the text with these parts holds."""
    inside = lambda t: F.length(t).between(2, 3) & F.contains(parts["long"], t)
    return overlap(tokens, parts["whole"]) + F.size(F.filter(F.array_except(tokens, parts["whole"]), inside))
