"""Text expressions. All are JVM-side column expressions; no Python workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the code points Python counts as white space, as a regex class body.
SPACE = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
STRIP_PATTERN = rf"\A[{SPACE}]+|[{SPACE}]+\z"
SPACES = "".join(map(chr, (*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
WORD_PATTERN = r"[\p{L}\p{N}]+"
NUMBER_PATTERN = r"[0-9]+(?:\.[0-9]+)?"
NETLOC_PATTERN = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
# Fixed value: the evidence marker in texts.
CITATION_PATTERN = r"\[ev[_:][^\]]+\]"
SENTENCE_END = rf"([.!?])[{SPACE}]+"

UPPER_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Named characters that pages use most.
ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&", "nbsp": " ", "copy": "©", "reg": "®", "trade": "™", "middot": "·", "bull": "•",
    "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "sbquo": "‚", "ldquo": "“", "rdquo": "”", "bdquo": "„", "laquo": "«",
    "raquo": "»", "sect": "§", "para": "¶", "deg": "°", "plusmn": "±", "times": "×", "divide": "÷", "frac12": "½", "euro": "€", "pound": "£",
    "yen": "¥", "cent": "¢", "iexcl": "¡", "iquest": "¿", "szlig": "ß", "agrave": "à", "aacute": "á", "acirc": "â", "atilde": "ã", "auml": "ä",
    "aring": "å", "aelig": "æ", "ccedil": "ç", "egrave": "è", "eacute": "é", "ecirc": "ê", "euml": "ë", "igrave": "ì", "iacute": "í",
    "icirc": "î", "iuml": "ï", "ntilde": "ñ", "ograve": "ò", "oacute": "ó", "ocirc": "ô", "otilde": "õ", "ouml": "ö", "oslash": "ø",
    "ugrave": "ù", "uacute": "ú", "ucirc": "û", "uuml": "ü", "yacute": "ý", "Agrave": "À", "Aacute": "Á", "Auml": "Ä", "Ccedil": "Ç",
    "Egrave": "È", "Eacute": "É", "Ntilde": "Ñ", "Oacute": "Ó", "Ouml": "Ö", "Uacute": "Ú", "Uuml": "Ü", "oelig": "œ", "OElig": "Œ",
}
ENTITY_PATTERN = r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Trim the same characters as Python's ``str.strip``."""
    # not by a pattern, which would be tried at every place of the text
    return F.btrim(c, F.lit(SPACES))


def is_blank(c: Column) -> Column:
    return ~c.rlike(f"[^{SPACE}]")  # seen at the first other character


def ascii_lower(c: Column) -> Column:
    """Fold A-Z only, as a case-insensitive SQL LIKE over ASCII does."""
    return F.translate(c, UPPER_ASCII, UPPER_ASCII.lower())


def netloc(url: Column) -> Column:
    """Lower-cased authority part (user info and port kept); '' when there is none."""
    return F.lower(F.regexp_extract(url, NETLOC_PATTERN, 1))


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD_PATTERN), F.lit(0))


def _run_lengths(sorted_items: Column) -> Column:
    """(token, n) of each run of equal items."""
    before = lambda x, i: F.coalesce(F.get(sorted_items, i - 1) != x, F.lit(True))
    starts = F.filter(F.transform(sorted_items, lambda x, i: F.when(before(x, i), i)), lambda i: i.isNotNull())

    def run(s: Column) -> Column:
        length = lambda i, k: (F.coalesce(F.get(s, k + 1), F.size(sorted_items)) - i).cast("bigint")
        return F.transform(s, lambda i, k: F.struct(F.get(sorted_items, i).alias("token"), length(i, k).alias("n")))

    return bind(starts, run)


def token_counts(c: Column) -> Column:
    """(token, n) of each distinct token, counted inside the row over its sorted tokens."""
    return bind(F.sort_array(tokens(c)), _run_lengths)


def counts(df: DataFrame, items: str, *keep: str) -> DataFrame:
    """``keep`` and ``_counts``: (token, n) of each distinct element of the array ``items``, counted inside the row."""
    return df.select(*keep, bind(F.sort_array(items), _run_lengths).alias("_counts"))


def numbers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(NUMBER_PATTERN), F.lit(0))


def word_count(c: Column) -> Column:
    """Number of white-space separated words."""
    return F.size(F.filter(F.split(c, f"[{SPACE}]+"), lambda w: w != "")).cast("bigint")


def _character(name: Column) -> Column:
    """What a reference (its text between & and ;) stands for, null if nothing."""
    hexa = F.substring(name, 2, 1).isin("x", "X")
    code = F.when(hexa, F.conv(F.substring(name, 3, 6), 16, 10)).otherwise(F.substring(name, 2, 7)).try_cast("int")
    real = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    numbered = F.when(real, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    named = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])
    return F.when(F.startswith(name, F.lit("#")), numbered).otherwise(F.try_element_at(named, name))


def unescape(c: Column) -> Column:
    """Character references read once: numeric ones and the names in ``ENTITIES``; others stay."""

    def part(text: Column, i: Column) -> Column:
        name = F.regexp_extract(text, ENTITY_PATTERN, 1)
        char = F.when((i > 0) & (name != ""), _character(name))
        whole = F.when(i > 0, F.concat(F.lit("&"), text)).otherwise(text)
        return F.when(char.isNull(), whole).otherwise(F.concat(char, F.substring(text, F.length(name) + 2, F.length(text))))

    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(F.split(c, "&"), part), "")).otherwise(c)


def paragraphs(c: Column) -> Column:
    """Stripped non-blank blocks between blank lines."""
    return F.filter(F.transform(F.split(c, "\n\n+"), strip), lambda p: p != "")


def chunk(markdown: Column, max_chars: int = 1500) -> Column:
    """Cut a text into pieces of at most ``max_chars``.

    Blocks that fit stay whole. Longer ones are packed line by line; a single line over the limit
    stays whole, so no text is lost.
    """

    def pack(block: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

        def step(acc: Column, line: Column) -> Column:
            full = (F.length(acc["cur"]) + F.length(line) + 1 > max_chars) & (acc["cur"] != "")
            return F.struct(
                F.when(full, F.concat(acc["done"], F.array(strip(acc["cur"])))).otherwise(acc["done"]).alias("done"),
                F.when(full | (acc["cur"] == ""), line)
                .otherwise(F.concat(acc["cur"], F.lit("\n"), line))
                .alias("cur"),
            )

        def close(acc: Column) -> Column:
            last = strip(acc["cur"])
            return F.when(last == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(last)))

        return F.aggregate(F.split(block, "\n"), start, step, close)

    return F.flatten(
        F.transform(
            paragraphs(markdown),
            lambda p: F.when(F.length(p) <= max_chars, F.array(p)).otherwise(pack(p)),
        )
    )


def citation_markers(c: Column) -> Column:
    """Bracketed evidence markers in reading order."""
    return F.regexp_extract_all(c, F.lit(CITATION_PATTERN), F.lit(0))


def citation_ids(c: Column) -> Column:
    """Ids inside the markers; ``[ev:x]`` gives x and ``[ev_x]`` gives ev_x."""
    return F.transform(citation_markers(c), lambda m: F.regexp_extract(m, r"^\[(?:ev:)?(.*)\]$", 1))


def citation_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(CITATION_PATTERN)).cast("bigint")


def sentences(c: Column) -> Column:
    """Sentences cut after . ! or ? followed by white space."""
    marked = F.regexp_replace(c, SENTENCE_END, "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), strip), lambda s: s != "")


def parse_iso(c: Column) -> Column:
    """ISO-8601 text to timestamp, else null; partial dates such as '2024' do not parse."""
    return F.when(c.rlike(r"^\d{4}-?\d{2}-?\d{2}"), c.try_cast("timestamp"))


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)


def any_of(items: Column, test) -> Column:
    """True when some element of a possibly null array passes ``test``."""
    return F.coalesce(F.exists(items, test), F.lit(False))
