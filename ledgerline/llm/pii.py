"""Operator 6, PII surrogates (DataFrame functions only).

Detected entities get keyed replacements of the same type and format: digits become digits, letters letters of
the same case and script, punctuation, titles and top-level domains stay. IPv6 addresses come out without "::". The
replacement is a function of the key, the type and the entity's canonical form (digits of a number, a phone's without
the leading 1 of North America, lower-case address), so one entity has one surrogate in all its spellings and documents.

Names are entities part by part: "Mr. Brown", "Mr Brown" and "Mr John Brown" share Brown's surrogate, whatever the title.
Given names (parts in front of the last) get one that fits the titles they stand with (any, if only after Dr and the
like), surnames one of their script; initials change, particles stay. Parts of a name found in a document are
replaced wherever they stand in it as words of their own, with or without a title.

Collision checks run over all distinct entities: a surrogate that two entities share, or that is itself an
entity of the corpus, is kept by the least entity at most; the others try again with the next attempt until no
conflict is left. Attempts above 0 and name parts are joined to the texts that need them on the text's hash.

Defined results: null and empty texts have no entities and stay as they are (null becomes empty); repeated rows
get a row each; text outside entities and mentions of their names is unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import packed, written

# Titles by gender, given names by gender and script.
TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Г-жа"],
          "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Sir", "Г-н"],
          "n": ["Dr", "Doctor", "Prof", "Professor", "Mx", "Rev"]}
GIVEN = {("f", "latin"): ["Anna", "Clara", "Elena", "Julia", "Laura", "Maria", "Nora", "Sofia"],
         ("m", "latin"): ["Adam", "Bruno", "David", "Felix", "Hugo", "Leon", "Martin", "Oscar"],
         ("f", "cyrillic"): ["Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Софья"],
         ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Игорь", "Олег", "Павел", "Роман", "Юрий"]}
SYLLABLES = {"latin": ["ba", "den", "for", "gal", "hin", "ka", "lor", "mel", "nov", "per", "ros", "sand", "tem", "ul", "ver", "win"],
             "cyrillic": ["ба", "ден", "фор", "гал", "хин", "ка", "лор", "мел", "нов", "пер", "рос", "сан", "тем", "ул", "вер", "вин"]}

GIVEN |= {("n", s): GIVEN["f", s] + GIVEN["m", s] for s in ("latin", "cyrillic")}

_ANY_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
# A name's part: a word, joined words (O'Brien, Smith-Jones; a possessive 's is none) or an initial before another part.
_JOINED = r"(?:['’](?!s(?!\p{L}))|-)\p{L}++"
_PARTICLE = "van|von|zu|de|der|den|del|della|di|da|dos|la|le|bin|al|el|ter"
_PART = rf"\p{{Lu}}(?:\p{{L}}++(?:{_JOINED})*+|(?:{_JOINED})++|\.(?= (?:(?:{_PARTICLE}) )*\p{{Lu}}))"
_HEX = "[0-9A-Fa-f]{1,4}"
_IPV6 = (r"(?<![\w:.])(?=[0-9A-Fa-f:]*(?:\d|[A-Fa-f]:[A-Fa-f]+:))"
         rf"(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:(?:{_HEX}:){{0,5}}\d{{1,3}}(?:\.\d{{1,3}}){{3}}"
         rf"|{_HEX}(?::{_HEX}){{0,6}})?)(?![\w:]|\.\d)")
# Kinds in the order in which they are tried at a place. Starts are anchored by what stands in front and runs are
# possessive, so a long text is read in one pass.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "card": r"(?<!\d)(?:\d{16}|[3-6]\d{12,14}|[3-6]\d{16,18}|\d{4}-\d{4}-\d{4}-\d{4}(?:-\d{1,3})?"
            r"|\d{4} \d{4} \d{4} \d{4}(?: \d{3})?|3\d{3}-\d{6}-\d{4,5}|3\d{3} \d{6} \d{4,5})(?!\d)",
    "ip": rf"(?<![\d.])\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}(?!\d|\.\d)|{_IPV6}",
    "phone": r"(?<!\d)(?:\+\d{1,3} ?\(\d{2,4}\) ?\d{3}[ -]\d{4}|\+\d{8,14}|(?<![\d-])\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}"
             r"|\+?(?<![\d-]|[\d-]\+)1[ .-]\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}|(?<![\d-])\d{3}[ .-]\d{3}[ .-]\d{4}"
             r"|(?<![\d-])0\d{2,4}[ -]\d{3,4}[ -]\d{3,4}"
             r"|\+(?=(?:[ .()-]{0,2}\d){7,15}(?![ .-]?\d))\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{1,5}){2,6})(?!-?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "name": rf"(?<!\p{{L}})(?:{_ANY_TITLE})\.? {_PART}(?: (?:(?:{_PARTICLE}) )*{_PART})*",
}
ENTITY = "|".join(PATTERNS.values())
MAYBE = rf"[@0-9]|::|[A-Fa-f]:[A-Fa-f]|(?:{_ANY_TITLE})\.? "  # without this no entity can be there
PLAIN_ATTEMPTS = 8  # attempts before a surrogate also gets a suffix, where the format's space is exhausted
ENTITIES = "array<string>"


def kind_of(entity: Column) -> Column:
    out = None
    for kind, pattern in PATTERNS.items():
        hit = entity.rlike(rf"\A(?:{pattern})\z")
        out = F.when(hit, F.lit(kind)) if out is None else out.when(hit, F.lit(kind))
    return out


def _groups(entity: Column) -> Column:
    """The eight groups (fewer, if the last is dotted) of an IPv6 address in any spelling, without leading zeros."""
    left, right = F.substring_index(entity, "::", 1), F.substring_index(entity, "::", -1)
    of = lambda side: F.filter(F.split(F.lower(side), ":"), lambda g: g != "")
    n = F.when(entity.rlike(r"\."), 7).otherwise(8) - F.size(of(left)) - F.size(of(right))
    full = F.when(entity.contains("::"), F.concat(of(left), F.array_repeat(F.lit("0"), F.greatest(n, F.lit(0))), of(right))) \
        .otherwise(of(entity))
    return F.transform(full, lambda g: F.when(g.contains("."), g).otherwise(F.regexp_replace(g, r"\A0+(?=.)", "")))


def _digits(entity: Column) -> Column:
    return F.regexp_replace(entity, r"[^0-9]", "")


def canonical(kind: Column, entity: Column) -> Column:
    """The form that all spellings of an entity share; of a name, that of one part."""
    return F.when((kind == "ip") & entity.contains(":"), F.array_join(_groups(entity), ":")) \
        .when(kind == "phone", F.regexp_replace(_digits(entity), r"\A1(?=\d{10}\z)", "")) \
        .when(kind.isin("card", "ssn"), _digits(entity)).otherwise(F.lower(entity))


def _title(name: Column) -> Column:
    return F.regexp_extract(name, rf"\A((?:{_ANY_TITLE})\.? )", 1)


def _name_parts(name: Column) -> Column:
    return F.split(F.substr(name, F.length(_title(name)) + 1), " ")


def _is_word(part: Column) -> Column:
    """Whether a part of a name is neither a particle nor an initial."""
    return ~part.rlike(r"^\p{Ll}|\.$")


def _initial(part: Column, key: str) -> Column:
    """Another initial, a function of the key and the letter."""
    digit = F.conv(F.substring(F.sha2(F.concat(F.lit(key), part).cast("binary"), 256), 1, 1), 16, 10).cast("int")
    letters = F.when(part.rlike(r"^\p{IsCyrillic}"), F.lit("АБВГДЕЖЗИКЛМНОПР")).otherwise(F.lit("ABCDEFGHIKLMNOPR"))
    return F.concat(F.substr(letters, digit + 1, F.lit(1)), F.lit("."))


def _pick(digest: Column, at: int, choices: list[str]) -> Column:
    """One of 8 or 16 choices, by a hex digit of the digest."""
    digit = F.conv(F.substring(digest, at, 1), 16, 10).cast("int")
    return F.element_at(F.array(*map(F.lit, choices)), digit % len(choices) + 1)


def surrogate(kind: Column, entity: Column, attempt: Column, key: str, style: Column | None = None) -> Column:
    """The replacement of an entity; every spelling of one canonical form gets the same values in its own format.

    Of a name the entity is one part and ``style`` tells its use: a given name after titles of ``f``, ``m`` or any gender
    (``n``), or a surname (``s``).
    """
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canonical(kind, entity), attempt.cast("string")).cast("binary"), 512)

    def hexdigit(n: Column) -> Column:
        return F.conv(F.substr(digest, F.pmod(n, F.lit(128)) + 1, F.lit(1)), 16, 10).cast("int")

    chars = F.split(entity, "")

    # numbers: the n-th digit of the canonical form comes from the n-th hex digit, what stands in front of it stays
    ahead = F.length(_digits(entity)) - F.length(canonical(kind, entity))

    def digit(c: Column, i: Column) -> Column:
        n = F.length(_digits(F.substr(entity, F.lit(1), i))) - ahead
        return F.when(c.rlike("[0-9]") & (n >= 0), (hexdigit(n) % 10).cast("string")).otherwise(c)

    numbers = F.array_join(F.transform(chars, digit), "")
    octets = F.array_join(F.transform(F.split(entity, r"\."), lambda c, i: (
        (hexdigit(i * 2) * 16 + hexdigit(i * 2 + 1)) % 254 + 1).cast("string")), ".")
    # IPv6 addresses: zero groups stay, others keep their number of digits, until that format's space is exhausted
    def group(g: Column, i: Column) -> Column:
        first = F.lower(F.hex(hexdigit(i * 8) % 15 + 1))
        some = F.concat(first, F.substr(digest, i * 8 + 2, F.lit(3)))
        dotted = F.array_join(F.transform(F.split(g, r"\."), lambda o, j: (hexdigit(i * 8 + j * 2) * 15 + hexdigit(i * 8 + j * 2 + 1) + 1).cast("string")), ".")
        return (F.when(g.contains("."), dotted).when(attempt >= PLAIN_ATTEMPTS, some).when(g == "0", g)
                .otherwise(F.substr(some, F.lit(1), F.length(g))))

    six = F.array_join(F.transform(_groups(entity), group), ":")
    six = F.when(entity.rlike("[A-F]") & ~entity.rlike("[a-f]"), F.upper(six)).otherwise(six)
    # addresses: letters and digits change, the top-level domain and punctuation stay
    body = F.regexp_replace(entity, r"\.[^.]*$", "")

    def letter(c: Column, i: Column) -> Column:
        n = hexdigit(i) + 16 * (hexdigit(i + 64) % 2)
        low = F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), n % 26 + 1, F.lit(1))
        cyrillic = F.substr(F.lit("абвгдежзиклмнопрстуфхцчшщэюя"), n % 28 + 1, F.lit(1))
        return (F.when(c.rlike("[0-9]"), (n % 10).cast("string"))
                .when(c.rlike(r"\p{IsCyrillic}"), F.when(c.rlike(r"\p{Lu}"), F.upper(cyrillic)).otherwise(cyrillic))
                .when(c.rlike(r"\p{Lu}"), F.upper(low)).when(c.rlike(r"\p{L}"), low).otherwise(c))

    suffix = F.when(attempt >= PLAIN_ATTEMPTS, F.substring(digest, 100, 8)).otherwise(F.lit(""))
    address = F.concat(suffix, F.array_join(F.transform(F.split(body, ""), letter), ""),
                       F.substr(entity, F.length(body) + 1))
    other = (F.when(kind.isin("card", "phone", "ssn"), numbers).when((kind == "ip") & entity.contains(":"), six)
             .when(kind == "ip", octets).otherwise(address))
    if style is None:
        return other
    cyrillic = entity.rlike(r"\p{IsCyrillic}")

    def by_script(at: int, table: dict, gender: str | None = None) -> Column:
        name = lambda s: (gender, s) if gender else s
        return F.when(cyrillic, _pick(digest, at, table[name("cyrillic")])).otherwise(_pick(digest, at, table[name("latin")]))

    def syllables(at: int, n: int) -> Column:
        return F.concat(*[by_script(at + k, SYLLABLES) for k in range(n)])

    surname = F.concat(F.initcap(syllables(2, 4)), F.when(entity.contains("-"), F.concat(F.lit("-"), F.initcap(syllables(20, 3)))).otherwise(F.lit("")))
    listed = F.when(style == "f", by_script(1, GIVEN, "f")).when(style == "m", by_script(1, GIVEN, "m")).otherwise(by_script(1, GIVEN, "n"))
    made = F.initcap(F.concat(syllables(40, 3), F.when(style == "f", F.when(cyrillic, "а").otherwise("a")).otherwise(F.lit(""))))
    given = F.when(attempt == 0, listed).otherwise(made)           # the lists are short: later attempts are made up
    return F.when(kind == "name", F.concat(F.when(style == "s", surname).otherwise(given), suffix)).otherwise(other)


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(F.lit(7), text).alias("k1"), F.xxhash64(F.lit(8), text).alias("k2")]


def _entities(text: Column) -> Column:
    return F.when(text.rlike(MAYBE), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(F.array().cast(ENTITIES))


def find_entities(texts: DataFrame) -> DataFrame:
    """(k1, k2, kind, entity, canonical, style): the distinct entities of each distinct text, names by their parts."""
    found = (texts.select(*_text_key(F.col("text")), F.explode(F.array_distinct(_entities(F.col("text")))).alias("entity"))
             .withColumn("kind", kind_of(F.col("entity"))))
    bare = F.regexp_replace(_title(F.col("entity")), r"\.? $", "")
    gender = F.when(bare.isin(TITLES["f"]), "f").when(bare.isin(TITLES["m"]), "m").otherwise("n")
    parts = _name_parts(F.col("entity"))
    used = F.transform(parts, lambda p, i: F.struct(p.alias("entity"), F.when(i == F.size(parts) - 1, "s").otherwise(gender).alias("style")))
    whole = F.array(F.struct(F.col("entity"), F.lit(None).cast("string").alias("style")))
    pieces = F.when(F.col("kind") == "name", F.filter(used, lambda u: _is_word(u["entity"]))).otherwise(whole)
    return (found.select("k1", "k2", "kind", F.explode(pieces).alias("u")).select("k1", "k2", "kind", "u.entity", "u.style")
            .withColumn("canonical", canonical(F.col("kind"), F.col("entity"))).distinct())


def settled_surrogates(found: DataFrame, key: str) -> DataFrame:
    """(kind, canonical, attempt, replacement) of every distinct entity; the replacement is that of a sample spelling.

    The rounds end when no conflict is left; each works on what the round before left open.
    """
    # a sample spelling stands for the entity; its surrogate's canonical form is that of every spelling. A name part that
    # is a given name somewhere is taken for one, of the first gender it is used with
    real = written(found.groupBy("kind", "canonical").agg(F.min("entity").alias("entity"), F.min("style").alias("style")), "entities")
    todo, settled, attempt = real, [], 0
    while True:
        tried = todo.withColumn("replacement", surrogate(F.col("kind"), F.col("entity"), F.lit(attempt), key, F.col("style")))
        tried = tried.withColumn("new", canonical(F.col("kind"), F.col("replacement")))
        taken = real.select("kind", F.col("canonical").alias("new"))
        for s in settled:
            taken = taken.unionByName(s.select("kind", "new"))
        first = (tried.join(taken.distinct(), ["kind", "new"], "left_anti")
                 .groupBy("kind", "new").agg(F.min_by(F.struct("canonical", "replacement"), F.col("canonical")).alias("w"))
                 .select("kind", "new", "w.canonical", "w.replacement").withColumn("attempt", F.lit(attempt)))
        first = written(first, "surrogates")
        settled.append(first)
        todo = written(todo.join(first.select("kind", "canonical"), ["kind", "canonical"], "left_anti"), "open-entities")
        if todo.isEmpty():
            break
        attempt += 1
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    return out.select("kind", "canonical", "attempt", "replacement")


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """(_row, _new, _entities): each document's row, its text with surrogates, and the kinds found in order of place."""
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = written(find_entities(texts), "text-entities")
    settled = written(settled_surrogates(found, key), "settled-surrogates")
    needed = settled.filter((F.col("attempt") > 0) | (F.col("kind") == "name"))
    is_name = F.col("kind") == "name"
    own = F.when((F.col("entity") == F.upper("entity")) & (F.length("entity") > 1), F.upper("replacement")).otherwise(F.col("replacement"))
    by_text = written(found.join(needed, ["kind", "canonical"]).groupBy("k1", "k2").agg(
        F.collect_set(F.when(~is_name, F.struct("entity", "attempt"))).alias("_tries"),
        F.array_sort(F.collect_set(F.when(is_name, F.struct("entity", own.alias("new"))))).alias("_names")), "surrogates-by-text")
    rows = packed(docs).withColumn("_old", F.coalesce(F.col("_row.text").cast("string"), F.lit("")))
    rows = rows.select("*", *_text_key(F.col("_old"))).join(by_text, ["k1", "k2"], "left")
    entities = _entities(F.col("_old"))

    def name(e: Column) -> Column:
        def part(p: Column) -> Column:
            held = F.get(F.filter("_names", lambda t: t["entity"] == p), F.lit(0))["new"]
            return F.when(p.rlike(r"\.$"), _initial(p, key)).otherwise(F.coalesce(held, p))
        return F.concat(_title(e), F.array_join(F.transform(_name_parts(e), part), " "))

    def new(e: Column) -> Column:
        tried = F.get(F.filter("_tries", lambda t: t["entity"] == e), F.lit(0))["attempt"]
        kind = kind_of(e)
        return F.when(kind == "name", name(e)).otherwise(surrogate(kind, e, F.coalesce(tried, F.lit(0)), key))

    def mentions(b: Column) -> Column:
        """The text between entities with the parts of the document's names replaced where they stand as words."""
        word = lambda t: F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), t["entity"], F.lit(r"\E(?![\p{L}\p{N}])"))
        return F.aggregate("_names", b, lambda out, t: F.when(out.contains(t["entity"]), F.regexp_replace(out, word(t), t["new"])).otherwise(out))

    between = F.split("_old", ENTITY, -1)
    between = F.when(F.size("_names") > 0, F.transform(between, mentions)).otherwise(between)
    parts = F.zip_with(between, F.transform(entities, new), lambda b, e: F.concat(b, F.coalesce(e, F.lit(""))))
    return rows.select("_row", F.when(F.size(entities) > 0, F.array_join(parts, "")).otherwise(F.col("_old")).alias("_new"),
                       F.transform(entities, kind_of).alias("_entities"))


def pii_report(docs: DataFrame, key: str) -> DataFrame:
    """One row per document: doc_id, entities by kind, and the text with surrogates."""
    out = replace_entities(docs.select("doc_id", "text"), key)
    counts = [(F.size("_entities") - F.size(F.array_remove("_entities", kind))).cast("bigint").alias(f"n_{kind}")
              for kind in PATTERNS]
    return out.select(F.col("_row.doc_id").cast("bigint").alias("doc_id"),
                      F.size("_entities").cast("bigint").alias("n_entities"), *counts, F.col("_new").alias("text"))
