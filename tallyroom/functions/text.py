"""Column expressions over document texts and names.  Dialect: ASCII classes unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "array<string>"

#: Tokens that mark a text as unfinished.
PLACEHOLDERS = ("lorem ipsum", "todo", "tbd", "xxx", "fixme", "placeholder", "[insert", "[draft", "[tbc", "[tba")

#: Words without content.
STOPWORDS = tuple(
    "and any are but can did does for from had has have her him his its may not now our out per she than that the their them then there these they this those was were what when where which who whom whose why will with would should could shall all each such other into onto upon under over also been being only very more most some same own nor too yet your you".split()
)

#: Corporate suffixes in any case, those with a capital at least, those in one spelling; words after which "limited" is an adjective.
SUFFIXES = ("Limited", "Ltd", "PLC", "LLP", "LLC", "Inc", "GmbH", "AG", "SAS", "SARL", "SA", "BV", "NV", "AB", "Oy", "KK")
CAPITALISED_SUFFIXES = ("Incorporated",)
EXACT_SUFFIXES = ("SpA",)
ADJECTIVAL = ("by", "company", "companies", "liability", "partnership", "partnerships", "assurance", "recourse", "warranty", "warranties", "edition")

CJK = r"[぀-ヿ㐀-䶿一-鿿豈-﫿]"
SLOT = r"\b(\d{1,2}\.\d{1,2}\.\d{1,3})\b"


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def tokens(text: Column) -> Column:
    """Runs of anything but white space (also beyond ASCII)."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")


def wordcount(text: Column) -> Column:
    """White-space tokens outside CJK, plus half the CJK characters."""
    return (F.size(tokens(F.regexp_replace(text, CJK, " "))) + F.floor(F.regexp_count(text, F.lit(CJK)) / 2)).cast("long")


def content_words(text: Column) -> Column:
    """Distinct lower-case words and numbers of three or more characters, no function words, plain plurals folded."""
    found = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]+|[0-9]+(?:[.,][0-9]+)*"), 0), lambda t: F.replace(t, F.lit(","), F.lit("")))
    some = F.filter(found, lambda t: (F.length(t) >= 3) & ~t.isin(*STOPWORDS))
    plural = lambda t: t.rlike("^[a-z]{4,}s$") & ~t.endswith("ss")
    return F.array_distinct(F.transform(some, lambda t: F.when(plural(t), F.regexp_replace(t, "s$", "")).otherwise(t)))


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines as token arrays; tables are left out, leading numbers dropped."""
    blocks = F.filter(F.split(text, r"\n[ \t\r]*\n"), lambda b: ~F.ltrim(b).startswith("|"))
    words = F.transform(blocks, lambda b: F.regexp_extract_all(F.lower(b), F.lit("[a-z0-9]+"), 0))
    first = lambda w: F.array_position(F.transform(w, lambda t: t.rlike("[^0-9]")), True)
    return F.transform(words, lambda w: F.when(first(w) > 0, F.slice(w, first(w).cast("int"), F.size(w))).otherwise(F.array().cast(EMPTY)))


def _is_gap(sep: Column) -> Column:
    """White space between words of one name: blanks, and one line break at most."""
    return (sep != "") & sep.rlike(r"\A[ \t]*\n?[ \t]*\z")


def entity_tokens(text: Column) -> Column:
    """Names of up to four capitalised words and a corporate suffix, sorted; "The" goes where two words are left without it.

    The text is cut into words and what separates them.  Suffix words are found by lookup; from each, the capitalised words that lead to it are counted back; a
    suffix that the same words still reach extends the name before it."""
    word = r"[\p{L}\p{N}_&'’-]"
    cut = F.lit(rf"({word}+)((?s:.)*?)(?={word}|\z)")
    words, seps = F.regexp_extract_all(text, cut, 1), F.regexp_extract_all(text, cut, 2)
    stem = lambda w: F.regexp_extract(w, r"^[\p{L}\p{N}_]+", 0)
    at = lambda xs, i: F.coalesce(F.get(xs, i), F.lit(""))
    capital = F.lit("^[A-Z]")

    def suffix(w: Column) -> Column:
        s = stem(w)
        first = lambda x: (F.lower(s) == x.lower()) & s.startswith(x[0])
        out = F.lower(s).isin(*(x.lower() for x in SUFFIXES)) | s.isin(*EXACT_SUFFIXES)
        for x in CAPITALISED_SUFFIXES:
            out = out | first(x)
        return out

    parts = F.struct(words.alias("w"), seps.alias("g"))

    def names(p: Column) -> Column:
        w, g = p["w"], p["g"]
        leads = lambda i: F.regexp_like(at(w, i), capital) & _is_gap(at(g, i))
        opening = lambda x: F.regexp_extract(x, r"(?s)(?:^|[&'’-])([A-Z].*)$", 1)
        begins = lambda i: (opening(at(w, i)) != "") & _is_gap(at(g, i))
        adjective = lambda i: (stem(at(w, i)) == at(w, i)) & _is_gap(at(g, i)) & F.lower(stem(at(w, i + 1))).isin(*ADJECTIVAL)
        ends = F.filter(F.transform(w, lambda x, i: F.when(suffix(x), i)), lambda i: i.isNotNull())

        def reach(e: Column) -> Column:
            """How many words lead to the suffix at e; one that begins behind a mark inside a word can only be the first."""
            one = [F.when(begins(e - k), k) for k in (1, 2, 3, 4)]
            return F.coalesce(F.when(leads(e - 1) & leads(e - 2) & leads(e - 3), one[3]), F.when(leads(e - 1) & leads(e - 2), one[2]), F.when(leads(e - 1), one[1]), one[0], F.lit(0))

        able = F.filter(F.transform(F.filter(ends, lambda e: ~adjective(e)), lambda e: F.struct(e.cast("int").alias("e"), reach(e).cast("int").alias("n"))), lambda x: x["n"] > 0)
        spans = "array<struct<s:int,e:int>>"

        def step(acc: Column, x: Column) -> Column:
            last = F.get(acc, F.size(acc) - 1)
            longer = F.coalesce((x["e"] - last["s"] <= 4) & (x["e"] - x["n"] <= last["s"]), F.lit(False))
            start = F.greatest(x["e"] - x["n"], F.coalesce(last["e"] + 1, F.lit(0)))
            new = F.array(F.struct(F.when(longer, last["s"]).otherwise(start).alias("s"), x["e"].alias("e")))
            return F.when(longer, F.concat(F.slice(acc, 1, F.size(acc) - 1), new)).when(start < x["e"], F.concat(acc, new)).otherwise(acc)

        found = F.aggregate(able, F.array().cast(spans), step)
        said = lambda m: F.concat_ws(" ", opening(at(w, m["s"])), F.slice(w, m["s"] + 2, m["e"] - m["s"] - 1), stem(at(w, m["e"])))
        return F.transform(found, said)

    every = F.get(F.transform(F.array(parts), names), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(every, lambda t: F.when(t.startswith("The ") & (F.size(F.split(t, " ")) > 2), F.substr(t, F.lit(5))).otherwise(t))))


def mask_names(text: Column, names: list[str]) -> Column:
    """Every name replaced by a space, in any case, its words parted by blanks with one line break at most; where names overlap the longest stands.

    Text and names are cut into the same pieces (runs of letters and digits, white space, single characters), and a name is looked for piece by piece only in texts that
    have all of its words."""
    cut = F.lit(r"[A-Za-z0-9]+|[ \t\n]+|(?s:.)")
    pieces = lambda t: F.regexp_extract_all(t, cut, 0)
    alike = lambda xs: F.transform(xs, lambda x: F.when(_is_gap(x), " ").otherwise(F.lower(x)))
    listed = [F.struct(F.lit(n).alias("name"), alike(pieces(F.lit(" ".join(n.split())))).alias("seq"), F.array(*(F.lit(w.lower()) for w in n.split())).alias("words")) for n in sorted({x for x in names if x.split()})]
    if not listed:
        return text
    known = F.array(*listed)
    solid = lambda x: F.coalesce(F.regexp_like(x, F.lit("^[A-Za-z0-9]")), F.lit(False))

    def masked(t: Column) -> Column:
        parts = F.struct(pieces(t).alias("raw"), alike(pieces(t)).alias("low"), F.filter(known, lambda n: F.forall(n["words"], lambda w: F.contains(F.lower(t), w))).alias("names"))

        def places(p: Column) -> Column:
            low = p["low"]
            here = lambda n, i: (F.get(n["seq"], F.lit(0)) == F.get(low, i)) & (F.slice(low, i + 1, F.size(n["seq"])) == n["seq"]) & ~solid(F.get(low, i + F.size(n["seq"]))) & ~(solid(F.get(low, i - 1)))
            one = lambda n: F.transform(F.filter(F.transform(low, lambda x, i: F.when(here(n, i), i)), lambda i: i.isNotNull()), lambda i: F.struct((-F.length(n["name"])).alias("long"), n["name"].alias("name"), i.cast("int").alias("a"), (i + F.size(n["seq"])).cast("int").alias("b")))
            every = F.array_sort(F.flatten(F.transform(p["names"], one)))
            free = lambda acc, m: ~F.exists(acc, lambda o: (o["a"] < m["b"]) & (m["a"] < o["b"]))
            taken = F.aggregate(every, F.array().cast("array<struct<a:int,b:int>>"), lambda acc, m: F.when(free(acc, m), F.concat(acc, F.array(F.struct(m["a"].alias("a"), m["b"].alias("b"))))).otherwise(acc))
            return F.struct(p["raw"].alias("raw"), taken.alias("taken"))

        def written(q: Column) -> Column:
            inside = lambda i: F.exists(q["taken"], lambda m: (m["a"] <= i) & (i < m["b"]))
            first = lambda i: F.exists(q["taken"], lambda m: m["a"] == i)
            return F.array_join(F.transform(q["raw"], lambda x, i: F.when(first(i), " ").when(inside(i), "").otherwise(x)), "")

        return F.get(F.transform(F.transform(F.array(parts), places), written), F.lit(0))

    some = F.exists(known, lambda n: F.forall(n["words"], lambda w: F.contains(F.lower(text), w)))
    return F.when(some, masked(text)).otherwise(text)


def json_quoted(text: Column) -> Column:
    """A text as a JSON string of ASCII characters; null is null."""
    code = lambda c: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(c)), 4, "0"))
    short = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}

    def one(c: Column) -> Column:
        n = F.ascii(c)
        out = F.when(c == '"', short['"'])
        for k, v in list(short.items())[1:]:
            out = out.when(c == k, v)
        beyond = F.concat(code(F.lit(0xD800) + F.shiftright(n - 0x10000, 10)), code(F.lit(0xDC00) + (n - 0x10000).bitwiseAND(0x3FF)))
        return out.when((n >= 32) & (n < 127), c).when(n < 0x10000, code(n)).otherwise(beyond)

    plain = text.rlike(r'\A[ !#-\[\]-~]*\z')
    body = F.when(plain, text).otherwise(F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), ""))
    return F.when(text.isNull(), "null").otherwise(F.concat(F.lit('"'), body, F.lit('"')))


#: Words before the number of a clause.  "section" is none of them: it may be one of the room's.
CLAUSE_WORDS = ("clause", "sub-clause", "subclause", "paragraph", "sub-paragraph", "subparagraph", "schedule", "part", "article", "rule", "regulation", "condition")

#: References that can lie in the text that is looked at before one.
NEAR_REFS = 24


def refs_in_place(text: Column, before: int = 120) -> Column:
    """Slot-shaped references with what surrounds them: an array of ref, left (the ``before`` characters before it) and right (the rest of its line).

    The text is cut at its references, so each has what stands on both its sides, and no text is searched again for each."""
    held = r"(?<![\p{L}\p{N}_])\d{1,2}\.\d{1,2}\.\d{1,3}(?![\p{L}\p{N}_])"
    parts = F.struct(F.split(text, held).alias("p"), F.regexp_extract_all(text, F.lit(f"({held})"), 1).alias("r"))
    cut = F.transform(F.array(parts), lambda x: F.struct(x["p"].alias("p"), x["r"].alias("r"), F.transform(x["p"], lambda t: F.right(t, F.lit(before))).alias("t")))
    cut = F.transform(cut, lambda x: F.struct(x["p"].alias("p"), x["r"].alias("r"), x["t"].alias("t"), F.zip_with(F.slice(x["t"], 1, F.size(x["r"])), x["r"], lambda t, r: F.concat(t, r)).alias("z")))

    def placed(x: Column) -> Column:
        earlier = lambda i: F.array_join(F.slice(x["z"], F.greatest(i - NEAR_REFS, F.lit(0)) + 1, F.least(i, F.lit(NEAR_REFS))), "")
        left = lambda i: F.right(F.concat(earlier(i), F.get(x["t"], i)), F.lit(before))
        return F.transform(x["r"], lambda r, i: F.struct(r.alias("ref"), left(i).alias("left"), F.split_part(F.get(x["p"], i + 1), F.lit("\n"), F.lit(1)).alias("right")))

    return F.get(F.transform(cut, placed), F.lit(0))


def is_clause_number(left: Column) -> Column:
    """Whether what stands before a slot-shaped reference makes it a clause's number: it opens its line (after heading marks, or in bold or italics, but not in a list or
    table), or follows a word for a clause, directly or after further numbers."""
    opens = left.rlike(r"(?:\A|\n)[ \t]*(?:#{1,6}[ \t]+)?(?:\*\*?|__?)?\z")
    number, link = r"\d[\d.]*(?:\([a-z0-9]+\))*", r"(?:,\s*(?:and/or|and|or|to)?|and/or|and|or|to|[–-])"
    words = "|".join(sorted(CLAUSE_WORDS, key=len, reverse=True))
    return opens | left.rlike(rf"(?i)(?<![\p{{L}}\p{{N}}_])(?:{words})s?\s+(?:{number}\s*{link}\s*)*\z")


def slot_refs(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(SLOT), 1))


def finding_id_pattern(prefixes: list[str]) -> str:
    return rf"\b(?:{'|'.join(prefixes)})-\d+(?![A-Za-z0-9])|\bDX-\d+(?![A-Za-z0-9])"


def isolated(text: Column, needle: Column) -> Column:
    """Whether ``needle`` occurs with no digit or letter directly before or after; an empty needle does not."""
    quoted = F.concat(F.lit("(?<![\\p{Nd}\\p{L}])\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E(?![\\p{Nd}\\p{L}])"))
    return F.when(needle == "", False).otherwise(F.contains(text, needle) & F.regexp_like(text, quoted))


def runs(text: Column) -> Column:
    """Distinct runs of digits and letters."""
    return F.array_distinct(F.filter(F.split(text, r"[^\p{Nd}\p{L}]+"), lambda r: r != ""))


def document_date(text: Column) -> Column:
    """The date in the first 25 lines that are not blank: on a line that begins with Date or Dated, else the first."""
    months = "January|February|March|April|May|June|July|August|September|October|November|December"
    head = F.slice(F.filter(lines(text), lambda x: F.trim(x) != ""), 1, 25)
    pattern = rf"\b(\d{{1,2}})(?:st|nd|rd|th)? ({months}) (\d{{4}})\b"
    found = lambda xs: F.get(F.filter(F.transform(xs, lambda x: F.regexp_replace(F.regexp_extract(x, pattern, 0), "(?<=\\d)(st|nd|rd|th)", "")), lambda x: x != ""), F.lit(0))
    dated = F.filter(head, lambda x: x.rlike(r"(?i)^[\s*_#]*dated?\b"))
    return F.try_to_date(F.coalesce(found(dated), found(head)), "d MMMM yyyy")


def blanks(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[[A-Z][^\[\]\n]{0,80}\]"), 0))


def placeholder(text: Column, listed=PLACEHOLDERS) -> Column:
    """The first listed token in the text, or null."""
    low = F.lower(text)
    return F.coalesce(*(F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in listed))


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def claimed_ids(block: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(block, F.lit(r"\*\*([^\s()*]+)\s*\("), 1))


def bold_spans(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\*\*([^*\n]+)\*\*"), 1)


def twin_body(text: Column, marker: str) -> Column:
    """What stands before the last marker, or null where there is none."""
    found = F.regexp_extract(text, rf"(?s)\A(.*)\n\Q{marker}\E\n", 1)
    return F.when(F.contains(text, F.lit(f"\n{marker}\n")), found)


def annotation(ids_titles: Column, marker: str) -> Column:
    """A block for (finding_id, title, substance) rows in order."""
    rows = F.transform(ids_titles, lambda r: F.concat(F.lit("- **"), r["finding_id"], F.lit(" ("), r["title"], F.lit(")** "), r["substance"]))
    return F.concat(F.lit(f"\n{marker}\n"), F.array_join(rows, "\n"), F.lit("\n"))


def stem_hash(seed: int, *parts: Column) -> Column:
    """First eight bytes of sha256 over seed and parts joined by bars, as an unsigned number."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), *parts), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def hits(seed: int, path: Column, purpose: str, basis_points: int) -> Column:
    return stem_hash(seed, path, F.lit(purpose)) % 10000 < basis_points


#: Endings of renamed copies.
RENAME_TAGS = (" v2", " v4", " FINAL", " final clean", " (1)", " (conformed copy)", " - execution version", " v3 FINAL FINAL")


def renamed(seed: int, path: Column, stem: Column) -> Column:
    """One of four misnamings, chosen by hash."""
    pick = (stem_hash(seed, path, F.lit("rename-variant")) % 4).cast("int")
    tag = F.get(F.array(*map(F.lit, RENAME_TAGS)), (stem_hash(seed, path, F.lit("rename-tag")) % len(RENAME_TAGS)).cast("int"))
    swapped = F.when(F.contains(stem, F.lit("-")), F.replace(stem, F.lit("-"), F.lit(" "))).otherwise(F.replace(stem, F.lit("_"), F.lit(" ")))
    long = F.length(stem) > 4
    drop = F.when(long, stem_hash(seed, path, F.lit("rename-typo")) % F.when(long, F.length(stem) - 2).otherwise(1) + 1).cast("int")
    return (
        F.when(pick == 0, F.concat(stem, tag)).when(pick == 1, F.upper(stem))
        .when(pick == 2, F.when(swapped != stem, swapped).otherwise(F.replace(stem, F.lit(" "), F.lit("_"))))
        .otherwise(F.when(long, F.concat(F.substring(stem, F.lit(1), drop), stem.substr(drop + 2, F.length(stem)))).otherwise(F.concat(stem, F.lit(" (1)"))))
    )


def truncated(seed: int, path: Column, text: Column, least_lines: int = 30) -> Column:
    """The first 55 to 75 hundredths of the lines, chosen by hash, of texts with ``least_lines``; a last line break ends a line."""
    all_lines = F.split(text, "(?<=\n)")
    body = F.filter(all_lines, lambda x: x != "")
    keep = F.lit(0.55) + F.lit(0.2) * ((stem_hash(seed, path, F.lit("truncate-keep")) % 1000).cast("double") / 1000)
    n = F.greatest(F.lit(1), F.floor(F.size(body) * keep)).cast("int")
    return F.when(F.size(body) < least_lines, text).otherwise(F.array_join(F.slice(body, F.lit(1), n), ""))


#: Words written in capitals.
ACRONYMS = ("VAT", "NDA", "CPSE", "HSE", "QMS", "NCR", "CAPA", "DC", "ROPA", "DPIA", "JV", "ESG", "IT", "SPA", "EPC", "QA")


def title_case(slug: Column, acronyms: tuple[str, ...] = ACRONYMS) -> Column:
    """Sentence case of a dashed slug; acronyms (also plural) in capitals; the words w, and, i in a row are W&I."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(slug, "[-_ ]+", " "), r"(?i)(?<= |^)w and i(?= |$)", "W&I")), " ")
    named = F.transform(words, lambda w: F.when(F.upper(w).isin(*acronyms), F.upper(w)).when((F.length(w) >= 4) & w.endswith("s") & F.upper(F.regexp_replace(w, "s$", "")).isin(*acronyms), F.concat(F.upper(F.regexp_replace(w, "s$", "")), F.lit("s"))).otherwise(w))
    text = F.array_join(named, " ")
    return F.concat(F.upper(F.substring(text, 1, 1)), text.substr(F.lit(2), F.length(text)))
