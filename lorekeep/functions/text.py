"""Text functions as Column expressions; ASCII normalisation as the record's names are matched by it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorekeep import rules


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_name(c: Column) -> Column:
    """Lower case, without brackets, punctuation and legal suffixes."""
    s = F.regexp_replace(F.lower(c), r"\(.*?\)", " ")
    s = F.regexp_replace(F.regexp_replace(s, "&", " and "), "[^a-z0-9 ]+", " ")
    return squeeze(F.regexp_replace(s, rf"\b({'|'.join(rules.LEGAL_SUFFIXES)})\b", " "))


def normalize_phrase(c: Column) -> Column:
    """Lower case, possessives and apostrophes dropped, other signs to blanks."""
    s = F.regexp_replace(F.lower(c), r"[’']s\b", "")
    return F.trim(F.regexp_replace(F.regexp_replace(s, "[’']", ""), "[^a-z0-9]+", " "))


def normalize_subject(c: Column) -> Column:
    """A mail subject without reply, forward and list prefixes."""
    s = F.trim(F.lower(F.coalesce(c, F.lit(""))))
    return squeeze(F.regexp_replace(s, rules.SUBJECT_PREFIX, ""))


def split_multi(header: Column, cell: Column) -> Column:
    """The values of a cell that may hold several; placeholders are dropped."""
    several = cell.rlike("[;|]") | header.rlike(r"(?i)\(s\)") | F.trim(cell).rlike(rules.CODE_LIST)
    parts = F.when(several, F.split(cell, r"\s*[;|]\s*|\s*,\s*")).when(F.trim(cell).rlike(rules.INITIALS_LIST), F.split(cell, "/")).otherwise(F.array(cell))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(rules.PLACEHOLDER))


def trigrams(padded: Column) -> Column:
    size = F.length(padded) - 2
    grams = F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(padded, i, F.lit(3)))
    return F.when(size > 0, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def name_trigrams(c: Column) -> Column:
    """Trigrams of the whole name padded by two blanks before and one behind."""
    return trigrams(F.concat(F.lit("  "), c, F.lit(" ")))


def word_trigrams(c: Column) -> Column:
    """Trigrams of each alphanumeric word on its own, padded likewise (the database's definition)."""
    parts = F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")
    return F.array_distinct(F.flatten(F.transform(parts, name_trigrams)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")


def contains_name(a: Column, b: Column) -> Column:
    """Every word of the shorter name equals, or from four letters on begins, a word of the longer; one word has four letters."""
    wa, wb = words(a), words(b)
    short, long = F.when(F.size(wa) <= F.size(wb), wa).otherwise(wb), F.when(F.size(wa) <= F.size(wb), wb).otherwise(wa)
    fits = F.forall(short, lambda s: F.exists(long, lambda x: (x == s) | ((F.length(s) >= 4) & x.startswith(s))))
    return (F.size(short) > 0) & fits & F.exists(short, lambda s: F.length(s) >= 4)


def in_order(short: Column, long: Column) -> Column:
    """Whether the letters and digits of short occur in long in that order: one pass over long, with the place reached in short."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    asked = plain(short)
    reached = F.aggregate(F.split(plain(long), ""), F.lit(1), lambda at, letter: at + (asked.substr(at, F.lit(1)) == letter).cast("int"))
    return reached > F.length(asked)


def says_value(value: Column, text: Column) -> Column:
    """All numeric words of value occur in text, and three fifths of all its words."""
    asked, have = F.array_distinct(words(value)), words(text)
    numeric = F.filter(asked, lambda w: w.rlike("[0-9]"))
    hits = F.size(F.array_intersect(asked, have))
    return (F.size(asked) > 0) & (F.size(F.array_except(numeric, have)) == 0) & (hits >= 0.6 * F.size(asked))


def code_tokens(c: Column) -> Column:
    """Tokens with digits that look like numbers of quotes, assets or invoices; bare years are not."""
    found = F.regexp_extract_all(c, F.lit(r"\b([A-Za-z]*[-#]?\d[A-Za-z0-9-]{2,})\b"), F.lit(1))
    return F.filter(found, lambda t: ~t.rlike("^(19|20)[0-9]{2}$"))


def mask_digits(c: Column) -> Column:
    """All digits but the last four of each number become asterisks."""
    return F.regexp_replace(c, r"\d(?=\d{4})", "*")


def money(c: Column) -> Column:
    return F.regexp_replace(c, "[$,]", "").try_cast("double")


def field_label(c: Column) -> Column:
    # Words that are written in capitals.
    acronyms = {"pm": "PM", "tm": "T&M", "crm": "CRM", "vp": "VP", "ceo": "CEO", "cfo": "CFO", "sop": "SOP", "po": "PO", "ar": "AR", "hvac": "HVAC", "id": "ID", "qc": "QC", "gm": "GM"}
    known = F.create_map(*[F.lit(x) for kv in acronyms.items() for x in kv])
    text = F.array_join(F.transform(F.split(c, r"[_\s]+"), lambda w: F.coalesce(known[F.lower(w)], w)), " ")
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 20))


def clock(ms: Column) -> Column:
    s = F.floor(ms / 1000)
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)).otherwise(F.format_string("%d:%02d", F.floor(s / 60), s % 60))


def strip_markup(html: Column) -> Column:
    """Readable text of a page: scripts and styles go, tags become blanks, common entities are resolved."""
    s = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    s = F.regexp_replace(F.regexp_replace(s, r"(?s)<!--.*?-->", " "), "(?s)<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    return squeeze(s)


def url_identity(url: Column) -> Column:
    """One spelling of a page's address: no scheme, www, tracking parameters, fragment or final slash."""
    s = F.regexp_replace(F.lower(url), "^https?://(www\\.)?", "")
    s = F.regexp_replace(s, "#.*$", "")
    s = F.regexp_replace(s, "([?&])(utm_[a-z]+|fbclid|gclid|ref)=[^&]*", "$1")
    s = F.regexp_replace(F.regexp_replace(s, "([?&])&+", "$1"), "[?&]+$", "")
    return F.regexp_replace(s, "/+$", "")


def family_key(path: Column) -> Column:
    """A file name without dates, years and version markers: equal for the versions of one document."""
    s = F.lower(F.regexp_replace(F.element_at(F.split(path, "/"), -1), rules.FILE_ENDING, ""))
    for pattern in rules.FAMILY_NOISE:
        s = F.regexp_replace(s, pattern, " ")
    return squeeze(F.regexp_replace(s, r"\borg\b", "organization"))


def revision(path: Column) -> Column:
    s = F.lower(F.element_at(F.split(path, "/"), -1))
    rev, v = F.regexp_extract(s, r"\brev\s*([a-z]|\d+)\b", 1), F.regexp_extract(s, r"\bv\s?(\d+)", 1)
    return F.when(rev.rlike(r"^\d"), rev.cast("int")).when(rev != "", F.ascii(rev) - 96).when(v != "", v.cast("int")).otherwise(0)


def best_window(text: Column, asked: Column, width: int = 260, step: int = 40) -> Column:
    """The window of the text with the most distinct query words; the first of equals.

    The text is cut once into pieces of a step, and a window is put together from its few pieces, so that the cost
    is in proportion to the text.
    """
    pieces = F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(f"(?s).{{1,{step}}}"), F.lit(0)), F.array().cast("array<string>"))
    last = F.floor((F.greatest(F.length(text), F.lit(1)) - 1) / step).cast("int")
    full, rest = divmod(width, step)

    def best(cut: Column) -> Column:
        def scored(i: Column) -> Column:
            window = F.concat(F.array_join(F.slice(cut, i + 1, full), ""), F.coalesce(F.substring(F.get(cut, i + full), 1, rest), F.lit("")))
            hits = F.transform(F.array(window), lambda x: F.size(F.filter(asked, lambda w: F.contains(x, w))))
            return F.struct(hits[0].alias("hits"), (-i * step - 1).alias("at"))

        return F.array_max(F.transform(F.sequence(F.lit(0), last), scored))

    at = F.transform(F.array(pieces), best)[0]["at"]  # an array of one: the pieces are made once, not once a window
    return F.substring(text, -at, F.lit(width))


def delimited_records(c: Column, delimiter: str) -> Column:
    """The records of a delimited text as arrays of trimmed fields; records without any content are left out.

    Quotes are counted instead of parsed: what stands behind an odd number of them is quoted, so that its delimiters and line
    ends are content, and an empty stretch between two quoted ones is a doubled quote. One pass over the text, no backtracking. An open quote
    reaches to the end. The three noncharacters U+FDD0 to U+FDD2 stand for what is quoted meanwhile.
    """
    held = {delimiter: "\ufdd0", "\n": "\ufdd1", "\r": "\ufdd2"}
    parts = F.split(c, '"')

    def plain(part: Column, i: Column) -> Column:
        quoted = part
        for char, stand_in in held.items():
            quoted = F.replace(quoted, F.lit(char), F.lit(stand_in))
        doubled = (part == "") & (i > 0) & (i < F.size(parts) - 1)
        return F.when(i % 2 == 1, quoted).when(doubled, F.lit('"')).otherwise(F.regexp_replace(part, "\r\n?", "\n"))

    def field(cell: Column) -> Column:
        for char, stand_in in held.items():
            cell = F.replace(cell, F.lit(stand_in), F.lit(char))
        return F.regexp_replace(cell, r"^\s+|\s+$", "")

    lines = F.split(F.array_join(F.transform(parts, plain), ""), "\n")
    records = F.transform(lines, lambda line: F.transform(F.split(line, F.concat(F.lit("\\Q"), F.lit(delimiter), F.lit("\\E"))), field))
    return F.filter(records, lambda r: F.exists(r, lambda f: f != ""))
