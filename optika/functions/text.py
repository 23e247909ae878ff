"""Text, key and hash expressions on columns; all run inside Catalyst."""

from __future__ import annotations

import html
import re
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

#: Blank characters as Python's str.split sees them (Unicode blanks and the four separators).
BLANK = r"(?U)[\s\x1c-\x1f\x85]+"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: The same characters one by one.
BLANKS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def trim_blanks(x: Column) -> Column:
    """Without blanks at both ends: a look at the ends, where a pattern would try each blank of a text."""
    return F.trim(x, F.lit(BLANKS))


def let(x: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


#: What case folding makes of characters that lower case leaves, by Python's own tables: of one character one, or several.
_FOLDS = {c: c.casefold() for i in range(0x110000) if not 0xD800 <= i < 0xE000 for c in chr(i).lower() if c.casefold() != c}
_SINGLE = {c: f for c, f in _FOLDS.items() if len(f) == 1}
_SEVERAL = {c: f for c, f in _FOLDS.items() if len(f) > 1}
#: The one of several that common texts hold; it is replaced without a look at the others.
_SHARP = "\u00df"
_RARE = "".join(c for c in _SEVERAL if c != _SHARP)
#: Blanks beside the space: they become spaces in the same pass over a text as its letters.
_BLANKS = BLANKS.replace(" ", "")


#: Marks the rare ones in the pass over a text's letters.
_MARK = "\uffff"


def _folded(low: Column, more: str = "", by: str = "") -> Column:
    """A lower-cased text folded: one pass for characters that become one, which also marks those that become several;
    a text without marks is done, but for the sharp s."""
    several = F.lit(_SEVERAL[_SHARP])
    one = F.translate(low, "".join(_SINGLE) + more + _RARE, "".join(_SINGLE.values()) + by + _MARK * len(_RARE))
    rare = F.translate(low, "".join(_SINGLE) + more, "".join(_SINGLE.values()) + by)
    for c in _RARE:
        rare = F.replace(rare, F.lit(c), F.lit(_SEVERAL[c]))
    return F.replace(F.when(F.contains(one, F.lit(_MARK)), rare).otherwise(one), F.lit(_SHARP), several)


def _plain(x: Column) -> Column:
    """Whether a text has ASCII characters only, which lower case folds."""
    return F.octet_length(x) == F.char_length(x)


def casefold(x: Column) -> Column:
    """Case folding in generated code; its cost is that of lower case for ASCII texts and a few passes for others."""
    return F.when(_plain(x), F.lower(x)).otherwise(_folded(F.lower(x)))


#: Characters whose full upper case is several: what upper case of single characters makes of them.
_UPPERS = {c: "\u1e9e" if c == _SHARP else t if len(t := c.title()) == 1 else c for c in map(chr, range(0xD800)) if len(c.upper()) > 1}
_UPPERS |= {c: c for c in map(chr, range(0xE000, 0x110000)) if len(c.upper()) > 1}


def upper_each(x: Column) -> Column:
    """Upper case of each character alone, as SQL engines with one-to-one tables have it: a text keeps its number of
    characters, where F.upper makes SS of a sharp s.  Only texts that hold such a character are cut around them."""
    several = f"[{''.join(_UPPERS)}]"
    pairs = F.create_map(*(F.lit(v) for kv in _UPPERS.items() for v in kv))
    pieces = F.transform(F.split(x, f"(?<={several})|(?={several})"), lambda p: F.coalesce(F.try_element_at(pairs, p), F.upper(p)))
    return F.when(_plain(x) | ~x.rlike(several), F.upper(x)).otherwise(F.array_join(pieces, ""))


def normalized(x: Column) -> Column:
    """Blanks collapsed to one space, trimmed, case-folded."""
    ascii_blanks = "".join(c for c in _BLANKS if ord(c) < 128)
    plain = F.translate(F.lower(x), ascii_blanks, " " * len(ascii_blanks))
    spaced = F.when(_plain(x), plain).otherwise(_folded(F.lower(x), _BLANKS, " " * len(_BLANKS)))
    return F.trim(F.regexp_replace(spaced, " {2,}", " "))


def or_else(*xs: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in xs))


def template(fmt: str, *xs: Column) -> Column:
    """A template whose every %s stands for a column; nulls count as empty."""
    first, *rest = fmt.split("%s")
    if len(rest) != len(xs) or "%" in fmt.replace("%s", ""):
        raise ValueError(f"{fmt!r} must name its {len(xs)} columns by %s and hold no other %")
    return F.concat(F.lit(first), *(part for x, text in zip(xs, rest, strict=True) for part in (F.coalesce(x.cast("string"), F.lit("")), F.lit(text))))


def _unescape(xs: pd.Series) -> pd.Series:
    return xs.map(lambda x: html.unescape(x) if isinstance(x, str) and "&" in x else x)


#: A reference that its semicolon closes, and an ampersand with whatever may follow it.
_CLOSED = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);"
_AMPERSAND = re.compile(f"{_CLOSED}|&")


def _open_kept(x: str) -> str:
    """The text with the ampersands written out that begin no closed reference of a known name, so that decoding gives them back."""
    return _AMPERSAND.sub(lambda m: m[0] if m[0].startswith("&#") or m[0][1:] in html5 else "&amp;" + m[0][1:], x)


def _unescape_closed(xs: pd.Series) -> pd.Series:
    return xs.map(lambda x: html.unescape(_open_kept(x)) if isinstance(x, str) and "&" in x else x)


# The references that need no look into the list of all names; the ampersand comes last.
_USUAL = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&#x27;": "'", "&nbsp;": "\u00a0", "&amp;": "&"}


def unescape(x: Column, closed: bool = False) -> Column:
    """All HTML references decoded, once.  Texts whose references are the usual ones stay in generated code; others go
    to a Python worker.  closed: only references that end in a semicolon count, so that ``&amp`` stays as it is."""
    usual = x
    for name, char in _USUAL.items():
        usual = F.replace(usual, F.lit(name), F.lit(char))
    amp = F.contains(x, F.lit("&"))
    others = f"&(?!(?:{'|'.join(n[1:-1] for n in _USUAL)});)"
    odd = amp & x.rlike(others + _CLOSED[1:] if closed else others)
    decode = F.pandas_udf(_unescape_closed if closed else _unescape, "string")
    return F.when(~amp, x).when(~odd, usual).otherwise(decode(F.when(odd, x)))


def clean_html(x: Column, closed: bool = False) -> Column:
    """References decoded (closed: see ``unescape``), line breaks for <br>, tags dropped, blanks and tabs collapsed, trimmed;
    null counts as empty."""
    x = unescape(F.coalesce(x, F.lit("")), closed)
    tagless = lambda t: F.when(F.contains(t, F.lit("<")), F.regexp_replace(F.regexp_replace(t, r"<(?iU)br\s*/?>", "\n"), r"<[^>]+>", " ")).otherwise(t)
    spaced = lambda t: F.when(F.contains(t, F.lit("  ")) | F.contains(t, F.lit("\t")), F.regexp_replace(t, r"[ \t]{2,}|\t", " ")).otherwise(t)
    return trim_blanks(let(let(x, tagless), spaced))


class _Strings(HTMLParser):
    """The strings of a page between its tags and comments, without scripts, styles and templates."""

    SILENT = ("script", "style", "template")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.strings, self.silent, self.held = [], 0, []

    def cut(self) -> None:
        if s := "".join(self.held):
            if not s.strip("\t\n\x0c\r "):
                s = "\n" if "\n" in s else " "
            self.strings.append(s)
        self.held.clear()

    def handle_starttag(self, tag, attrs):
        self.cut()
        self.silent += tag in self.SILENT

    def handle_startendtag(self, tag, attrs):
        self.cut()

    def handle_endtag(self, tag):
        self.cut()
        self.silent -= tag in self.SILENT and self.silent > 0

    def handle_comment(self, data):
        self.cut()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def handle_data(self, data):
        if not self.silent:
            self.held.append(data)


def _strings(x: str) -> str:
    p = _Strings()
    p.feed(x)
    p.close()
    p.cut()
    return " ".join(p.strings)


def _page_text(xs: pd.Series) -> pd.Series:
    return xs.map(lambda x: html.unescape(_strings(x if isinstance(x, str) else "")).strip()).astype(object)


def _page_text_closed(xs: pd.Series) -> pd.Series:
    return xs.map(lambda x: _strings(_open_kept(x) if isinstance(x, str) else "").strip()).astype(object)


def page_text(x: Column, closed: bool = False) -> Column:
    """A page's strings joined by spaces, references decoded, trimmed; null counts as empty.  closed: only references that
    end in a semicolon count, and they are decoded once, where else a second pass decodes what the first one made."""
    return F.pandas_udf(_page_text_closed if closed else _page_text, "string")(x)


def level_index(x: Column) -> Column:
    """The zero-based level of a label such as ``Level 03`` or ``Toxicity level 2``; null if there is none."""
    return F.regexp_extract(x, r"(?i)level\s*0*([0-9]+)", 1).try_cast("int") - 1


def level_name(i: Column) -> Column:
    return F.format_string("Level %02d", i)


def letter(i: Column) -> Column:
    """The option key of a position: A for 0."""
    return F.substring(F.lit(LETTERS), i + 1, F.lit(1))


def language_name(code: Column, names: dict[str, str]) -> Column:
    """A language's name; unknown codes pass through."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), code)


def sha(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def normalized_sha(x: Column) -> Column:
    return sha(normalized(x))


def hash_rank(seed: int, *parts: Column) -> Column:
    """A sampling rank: SHA-256 of the seed and parts joined by the unit separator; a null part is written None."""
    return F.sha2(F.concat_ws("\x1f", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts)), 256)


def content_signature(source: Column, question: Column, context: Column, choices: Column) -> Column:
    """Identity of an item's content, without its answer."""
    body = F.struct(F.transform(choices, normalized).alias("choices"), normalized(context).alias("context"), normalized(question).alias("question"), normalized(source).alias("source"))
    return F.sha2(F.to_json(body, {"ignoreNullFields": "false"}), 256)


def cell_key(*parts: Column) -> Column:
    return F.to_json(F.array(*parts))


def python_float(x: Column) -> Column:
    """A double as Python prints it: no exponent from 0.0001 to below 1e16, else one of two digits or more."""
    j = F.abs(x).cast("string")
    e = F.substring_index(j, "E", -1).try_cast("int")
    digits = F.regexp_replace(F.replace(F.substring_index(j, "E", 1), F.lit("."), F.lit("")), "(?<=.)0+$", "")
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
    whole, rest = F.rpad(F.substring(digits, F.lit(1), e + 1), e + 1, F.lit("0")), F.substring(digits, e + 2, F.length(digits))
    large = F.concat(whole, F.lit("."), F.when(rest == "", "0").otherwise(rest))
    mantissa = F.when(F.length(digits) == 1, digits).otherwise(F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, F.lit(2), F.length(digits))))
    power = F.concat(mantissa, F.when(e < 0, "e-").otherwise("e+"), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))), F.lit("0")))
    plain = F.when(~F.contains(j, F.lit("E")), j).when((e < 0) & (e >= -4), small).when((e > 0) & (e < 16), large).otherwise(power)
    sign = F.when((x < 0) | (x.cast("string") == "-0.0"), "-").otherwise("")
    return F.when(F.isnan(x), "NaN").when(F.abs(x) == float("inf"), F.concat(sign, F.lit("Infinity"))).otherwise(F.concat(sign, plain))


#: Stand around a number's text inside a JSON string until the quotes are taken off.
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"


def _sorted(x: Column, kind: DataType) -> Column:
    """The same value with the keys of all its objects sorted and its doubles as marked texts."""
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(x.isNotNull(), F.struct(*(_sorted(x.getField(f.name), f.dataType).alias(f.name) for f in fields)))
    if isinstance(kind, ArrayType):
        return F.transform(x, lambda e: _sorted(e, kind.elementType))
    if isinstance(kind, MapType):
        entries = F.array_sort(F.transform(F.map_entries(x), lambda e: F.struct(e["key"].alias("key"), _sorted(e["value"], kind.valueType).alias("value"))), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        return F.map_from_entries(entries)
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(x.isNotNull(), F.concat(F.lit(_OPEN), python_float(x.cast("double")), F.lit(_CLOSE)))
    return x


def canonical_json(df: DataFrame, *cols: str) -> Column:
    """Canonical JSON of columns of df: keys sorted at every depth, compact, nulls kept, doubles as Python prints them."""
    kind = StructType([df.schema[c] for c in cols or df.columns])
    out = F.to_json(F.struct(*(_sorted(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name))), {"ignoreNullFields": "false"})
    return F.replace(F.replace(out, F.lit(f'"{_OPEN}'), F.lit("")), F.lit(f'{_CLOSE}"'), F.lit(""))


def canonical_sha(df: DataFrame, *cols: str) -> Column:
    return F.sha2(canonical_json(df, *cols), 256)


def question_context_sha(question: Column, context: Column) -> Column:
    """SHA-256 of the question, a zero character and the context."""
    return F.sha2(F.concat(question, F.lit("\0"), context), 256)


def suffix(path: Column) -> Column:
    """The last extension of a path's last part, with its dot; empty if there is none."""
    return F.regexp_extract(path, r"[^/](\.[^./]+)/*$", 1)


def stem(path: Column) -> Column:
    """A path's last part without its last extension."""
    return F.regexp_extract(path, r"([^/]+?)(?:(?<=[^/])\.[^./]+)?/*$", 1)


def relative_to(path: Column, root: str) -> Column:
    """The path below a root; null if it is not below it."""
    root = root.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substr(path, F.lit(len(root) + 1)))


def integer_seed(x: Column) -> Column:
    """The first 16 hexadecimal digits of a SHA-256 as a number."""
    return F.conv(F.substring(F.sha2(x, 256), 1, 16), 16, 10).cast("decimal(20,0)")
