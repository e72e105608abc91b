"""Tokenizers and text normalisation as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are never index tokens.
STOPWORDS = (
    "if", "else", "for", "while", "return", "switch", "case", "break", "continue", "goto", "default",
    "sizeof", "struct", "union", "enum", "typedef", "static", "const", "volatile", "extern", "void",
    "char", "short", "int", "long", "float", "double", "signed", "unsigned", "bool", "true", "false",
    "null", "auto", "register", "inline", "restrict", "asm", "class", "namespace", "template", "typename",
    "public", "private", "protected", "virtual", "friend", "this", "operator", "new", "delete", "try", "catch", "throw",
    "ret", "err", "rc", "val", "len", "size", "data", "buf", "tmp", "result", "status", "ctx", "priv", "info", "dev", "skb",
)
# Marks that are not line tokens, and words that look like calls but are none.
DROPPED_MARKS = (";", "(", ")", "{", "}", "[", "]", ",", ".")
CONTROL_WORDS = ("if", "for", "while", "switch", "return", "sizeof", "likely", "unlikely")
#: The language's own words among STOPWORDS.
KEYWORDS = STOPWORDS[: STOPWORDS.index("ret")]

#: Characters of a word and white space in any script; a word of any script, and one of ASCII letters, digits and underscore.
WORD_CHARS, SPACE_CHARS = r"\p{L}\p{N}_", r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
UNICODE_WORD, ASCII_WORD = rf"([{WORD_CHARS}]+)", r"([A-Za-z0-9_]+)"


def bound(value: Column, body) -> Column:
    """body(value), where value is worked out once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _useful(token: Column) -> Column:
    return (F.length(token) >= 3) & token.rlike("[a-zA-Z]") & ~F.lower(token).isin(*STOPWORDS)


def camel_parts(token: Column) -> Column:
    """XMLParser -> XML, Parser. A break goes in before the last capital of a run, which needs no look-ahead."""
    return F.regexp_extract_all(F.regexp_replace(token, "([A-Z])([A-Z][a-z])", "$1 $2"), F.lit("([A-Z]?[a-z]+|[A-Z]+)"))


def code_tokens(code: Column, word: str = UNICODE_WORD) -> Column:
    """The set of index tokens, in no order: words of three characters or more with a letter that are no stopwords, and
    under the same tests the parts that underscores and capitals cut them into. Null gives null.

    Words are made distinct before any test. Only those that are not of one case, with at most a capital in front, can
    have parts, so prose costs one pass of the pattern and one look at each distinct word.
    """

    def parts(token: Column) -> Column:
        camel = bound(camel_parts(token), lambda c: F.when(F.size(c) > 1, c).otherwise(F.array().cast("array<string>")))
        return F.concat(F.split(token, "_"), camel)

    def with_parts(whole: Column) -> Column:
        mixed = F.filter(whole, lambda t: ~t.rlike("^(?:[A-Z]?[a-z]+|[A-Z]+)$"))
        return F.array_distinct(F.concat(whole, F.filter(F.flatten(F.transform(mixed, parts)), _useful)))

    return bound(F.filter(F.array_distinct(F.regexp_extract_all(code, F.lit(word))), _useful), with_parts)


def strip_comments(code: Column) -> Column:
    """Code without /* */ and // comments; line breaks inside a comment stay, so line numbers hold. Strings are not
    looked at."""
    pieces = F.regexp_extract_all(code, F.lit(r"(?s)(/\*.*?\*/|[^/]+|/)"))
    kept = F.transform(pieces, lambda p: F.when(p.rlike(r"(?s)^/\*.*\*/$"), F.regexp_replace(p, "[^\n]", "")).otherwise(p))
    whole = F.when(F.contains(code, F.lit("/*")), F.array_join(kept, "")).otherwise(code)
    return F.regexp_replace(whole, "//[^\n]*", "")


def line_tokens(line: Column) -> Column:
    """The ordered lower-case tokens of one line: arrows, the parts of words and single marks, without its [n] marker,
    comments and punctuation that carries no meaning.

    Words and white space are those of any script. A word is cut at underscores, then into runs of ASCII letters by
    case and runs of digits; a part that has neither stays whole. A // comment is cut before a /* */ one.
    """
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(line, r"^\[\s*\d+\]", ""), "//[^\n]*", ""), r"/\*[^\n]*?\*/", "")
    raw = F.regexp_extract_all(bare, F.lit(rf"(->|[{WORD_CHARS}]+|[^{WORD_CHARS}{SPACE_CHARS}])"))

    def pieces(part: Column) -> Column:
        cut = F.regexp_extract_all(F.regexp_replace(part, "([A-Z])([A-Z][a-z])", "$1 $2"), F.lit(r"([A-Z]?[a-z]+|[A-Z]+|\p{Nd}+)"))
        return bound(cut, lambda c: F.when(F.size(c) > 0, c).otherwise(F.array(part)))

    def cut(token: Column) -> Column:
        simple = token.rlike(rf"^(?:[a-z]+|[^{WORD_CHARS}].*)$")
        parts = F.filter(F.split(token, "_"), lambda x: x != "")
        return F.when(simple, F.array(token)).otherwise(F.flatten(F.transform(parts, pieces)))

    return F.filter(F.transform(F.flatten(F.transform(raw, cut)), F.lower), lambda t: ~t.isin(*DROPPED_MARKS))


def line_number(line: Column) -> Column:
    """The number in a line's [n] marker, -1 without one."""
    return F.coalesce(F.regexp_extract(line, r"^\[\s*(\d+)\]", 1).try_cast("int"), F.lit(-1))


def variable_paths(code: Column) -> Column:
    """Distinct identifier paths such as a->b.c, in order, without keywords and single letters."""
    found = F.regexp_extract_all(code, F.lit(r"([A-Za-z_]\w*(?:(?:->|\.)[A-Za-z_]\w*)*)"))
    return F.array_distinct(F.filter(found, lambda v: (F.length(v) > 1) & ~v.isin(*KEYWORDS)))


def base_identifier(path: Column) -> Column:
    """The variable that a path starts from: dereferences, addresses, parentheses, members and subscripts go."""
    return F.regexp_extract(path, r"^[\s*&(]*([A-Za-z_]\w*)", 1)


def called_name(line: Column) -> Column:
    """The first name before a parenthesis that is no control word; null without one."""
    found = F.regexp_extract_all(line, F.lit(r"\b([a-zA-Z_][a-zA-Z0-9_]*)\s*\("))
    return F.get(F.filter(found, lambda n: ~n.isin(*CONTROL_WORDS)), F.lit(0))


def squeezed(text: Column) -> Column:
    """Text without any white space, for comparisons that ignore it."""
    return F.regexp_replace(text, r"\s+", "")


def normalised(code: Column) -> Column:
    """Code without comments and white space: equal for two functions that differ in nothing else."""
    return squeezed(strip_comments(code))


def quoted(word: str) -> str:
    """A regular expression for the word as it is written."""
    return "".join(c if c.isalnum() or c == "_" or c.isspace() else f"\\{c}" for c in word)


def diff_side(diff: Column, sign: str) -> Column:
    """The distinct lines that a diff adds (+) or deletes (-), without their sign, trimmed; empty ones and file headers
    are none."""
    own = F.filter(F.split(diff, "\n"), lambda x: x.startswith(sign) & ~x.startswith(sign * 3))
    return F.array_distinct(F.filter(F.transform(own, lambda x: F.trim(F.substr(x, F.lit(2)))), lambda x: x != ""))


def diff_features(diff: Column) -> Column:
    """A struct of distinct names in a diff's lines, added, deleted and kept ones alike: `calls`, names before a
    parenthesis; `members`, names behind an arrow or a dot; `tokens`, all other identifiers and calls.

    Comments, literals and keywords are left out first.
    """
    shown = F.filter(F.split(diff, "\n"), lambda x: x.rlike(r"^[ +-]"))
    code = strip_comments(F.array_join(F.transform(shown, lambda x: F.substr(x, F.lit(2))), "\n"))
    bare = F.regexp_replace(code, r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", "0")

    def names(pattern: str) -> Column:
        return F.array_distinct(F.filter(F.regexp_extract_all(bare, F.lit(pattern)), lambda n: ~n.isin(*KEYWORDS, *CONTROL_WORDS)))

    return F.struct(
        names(r"(?<![\w.>])([A-Za-z_]\w*)\s*\(").alias("calls"), names(r"(?:->|\.)\s*([A-Za-z_]\w*)").alias("members"), names(r"(?<![\w.>])([A-Za-z_]\w*)").alias("tokens")
    )
