"""Operator 5: personal data replaced by keyed surrogates, with DataFrame functions only.

Entities (e-mail and IP addresses, phone, card and social security numbers, bank accounts, secrets, and persons behind a
title) are found by one pattern. Each different entity in its canonical form (case and separators aside) gets one surrogate from a
keyed hash, so it reads the same in all documents, and is written in the form found: digits for digits, letters for letters of
the same case, country codes, a card's first digit and name spaces kept, check digits of cards and bank accounts made valid; persons
get names of the title's gender and the name's script. Secrets and addresses of any length are replaced whole.

Collision checks: a surrogate that another entity has, or that is itself an entity of the documents, is drawn again with the next
attempt, until all are distinct; after ``ATTEMPTS`` draws in the entity's own format, values get longer with each draw, so
formats with few values always find one. Only documents with entities are shuffled; a frequent entity is one row of the table of different
ones, and the join back on it is one that Spark splits when skewed.

Null texts stay null, texts without entities stay as they are, repeated rows stay repeated; rows with a null id are treated
alike; an empty table gives no rows; all other columns pass through under their own names.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrix.llm.common import drop_path, stored

ATTEMPTS = 24  # draws for an entity in its own format; later ones are longer
LONGER = 2     # digits (persons: syllables, addresses: numbers) that each later draw is longer by

# Titles by gender, and given names and syllables by script, for persons behind a title.
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Sra|Госпожа|госпожа|Κυρία|κυρία"
MALE = "Mr|Mister|Herr|Monsieur|Señor|Sr|Господин|господин|Κύριος|κύριος"
NAMES = {
    ("latin", "f"): ["Anna", "Clara", "Elena", "Irene", "Julia", "Laura", "Maria", "Nora", "Paula", "Rosa", "Sara", "Vera"],
    ("latin", "m"): ["Adam", "Bruno", "Carl", "David", "Erik", "Felix", "Hugo", "Jonas", "Leo", "Martin", "Oscar", "Paul"],
    ("cyrillic", "f"): ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Софья", "Татьяна"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Иван", "Максим", "Олег", "Павел", "Роман"],
    ("greek", "f"): ["Άννα", "Ελένη", "Ειρήνη", "Ιωάννα", "Μαρία", "Νίκη", "Σοφία", "Χριστίνα"],
    ("greek", "m"): ["Αλέξης", "Γιώργος", "Δημήτρης", "Ιάσων", "Κώστας", "Μιχάλης", "Νίκος", "Πέτρος"],
}
SYLLABLES = {
    "latin": ["ba", "den", "fi", "gor", "hal", "kin", "lam", "mer", "nos", "per", "ril", "sen", "tor", "vin", "wal", "zim"],
    "cyrillic": ["ба", "ден", "фи", "гор", "кин", "лам", "мер", "нос", "пер", "рил", "сен", "тор", "вин", "зим", "жук", "чер"],
    "greek": ["βα", "δεν", "φι", "γορ", "κιν", "λαμ", "μερ", "νος", "περ", "ριλ", "σεν", "τορ", "θαν", "ζημ", "ξαν", "ψαρ"],
}
SURNAME_ENDS = {"latin": ["er", "son", "ini", "eau"], "cyrillic": ["ко", "ян", "их", "ук"], "greek": ["ου", "άκη", "έλη", "ίδη"]}

# One pattern for all entities, most specific first.
# Runs are taken whole, from where they begin and without backing off, so a long one costs one pass and leaves no end in clear.
EMAIL = r"(?<![A-Za-z0-9._%+-])[._%+-]*+[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}"
#: A value up to white space or a quote, of eight characters or more with a letter or digit among them.
NAMED = r"(?i:password|passwd|pwd|token|secret|api[_-]?key)[\"']?(?:[ \t]*|\s{0,3})[=:](?:[ \t]*|\s{0,3})[\"']?"
SECRET = rf"\b{NAMED}(?=[^\s\"'\p{{L}}\p{{N}}]*+[\p{{L}}\p{{N}}])[^\s\"']{{8,}}+|\bAKIA[A-Z0-9]{{16}}\b"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
PHONE = (r"(?<![0-9])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])"
         r"|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9-])")
PERSON = rf"(?<!\p{{L}})(?:{FEMALE}|{MALE})(?:\. ?| )\p{{Lu}}\p{{Ll}}{{1,30}}(?: \p{{Lu}}\p{{Ll}}{{1,30}})?(?!\p{{L}})"
PATTERN = "|".join((EMAIL, SECRET, IP, SSN, IBAN, PHONE, CARD, PERSON))

# Texts without any of these characters or words hold no entity; checked before the pattern.
HINT = rf"[0-9@]|(?i:password|passwd|pwd|token|secret|api.?key)|AKIA|{FEMALE}|{MALE}"
_VALUE = rf"^{NAMED}"
_TITLE = rf"^(?:{FEMALE}|{MALE})(?:\. ?| )"


def kind_of(value: Column) -> Column:
    return (
        F.when(value.rlike(rf"^(?:{EMAIL})$"), "email")
        .when(value.rlike(rf"^(?:{SECRET})$"), "secret")
        .when(value.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), "ip")
        .when(value.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(value.rlike(r"^[A-Z]{2}[0-9]{2}"), "iban")
        .when(value.rlike(rf"^(?:{PHONE})$"), "phone")
        .when(value.rlike(r"^[0-9]"), "card")
        .otherwise("person")
    )


def canonical(kind: Column, value: Column) -> Column:
    """What is the same in all ways to write an entity."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    country = F.regexp_extract(value, r"^\+([0-9]{1,3})(?=[ .(-])", 1)
    gender = F.when(value.rlike(rf"^(?:{FEMALE})"), "f ").otherwise("m ")
    return (
        F.when(kind == "email", F.lower(value))
        .when(kind == "secret", F.regexp_replace(value, _VALUE, ""))
        .when(kind == "phone", F.concat(country, F.lit("+"), F.substr(digits, F.length(country) + 1)))
        .when(kind.isin("ssn", "card"), digits)
        .when(kind == "iban", F.regexp_replace(value, " ", ""))
        .when(kind == "person", F.concat(gender, F.regexp_replace(value, _TITLE, "")))
        .otherwise(value)
    )


def _pick(options: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (F.pmod(number, F.lit(len(options))) + 1).cast("int"))


def _chars(text: Column, seed: Column, hexadecimal: Column | bool = False) -> Column:
    """Every letter and digit replaced by one of its kind; those that aren't ASCII become ASCII ones."""
    def one(c: Column, k: Column) -> Column:
        r = F.xxhash64(seed, k)

        def of(letters: str) -> Column:
            return F.substring(F.lit(letters), F.pmod(r, F.lit(len(letters))).cast("int") + 1, F.lit(1))

        letter = (F.when(c.rlike("[0-9]"), of("0123456789")).when(c.rlike("[a-z]"), of("abcdefghijklmnopqrstuvwxyz"))
                  .when(c.rlike("[A-Z]"), of("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).when(c.rlike(r"\p{Lu}"), of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
                  .when(c.rlike(r"[\p{L}\p{M}]"), of("abcdefghijklmnopqrstuvwxyz")).when(c.rlike(r"\p{N}"), of("0123456789"))
                  .otherwise(c))
        if hexadecimal is False:
            return letter
        return F.when(hexadecimal & (c != ""), of("0123456789abcdef")).otherwise(letter)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _check_digit(digits: Column) -> Column:
    """The Luhn check digit of a number without one."""
    n = F.length(digits)

    def part(k: Column) -> Column:
        d = F.substring(digits, n - k, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(k % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), part), F.lit(0), lambda a, x: a + x)
    return F.pmod(F.lit(10) - total % 10, F.lit(10)).cast("string")


def _valid_iban(text: Column) -> Column:
    """``text`` with the check digits (its third and fourth character) that make it valid."""
    moved = F.concat(F.substr(text, F.lit(5)), F.substring(text, 1, 2), F.lit("00"))
    letter = lambda c: F.ascii(c) - 55  # noqa: E731  A is 10

    def step(rest: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + letter(c)) % 97)

    rest = F.aggregate(F.split(moved, ""), F.lit(0), step)
    return F.concat(F.substring(text, 1, 2), F.lpad((98 - rest).cast("string"), 2, "0"), F.substr(text, F.lit(5)))


def _person(canon: Column, seed: Column, attempt: Column) -> Column:
    female, name = canon.startswith("f "), F.substr(canon, F.lit(3))
    several = name.contains(" ")

    def named(script: str) -> Column:
        given = F.when(female, _pick(NAMES[script, "f"], F.xxhash64(seed, F.lit(0)))).otherwise(
            _pick(NAMES[script, "m"], F.xxhash64(seed, F.lit(1))))
        parts = [_pick(SYLLABLES[script], F.xxhash64(seed, F.lit(k))) for k in (2, 3, 4)]
        # later attempts draw from longer names, so that there is always room
        more = F.when(attempt > 1, F.concat(*(_pick(SYLLABLES[script], F.xxhash64(seed, F.lit(k))) for k in (6, 7, 8))))
        family = F.initcap(F.concat(*parts, F.coalesce(more, F.lit("")), _pick(SURNAME_ENDS[script], F.xxhash64(seed, F.lit(5)))))
        return F.when(several, F.concat(given, F.lit(" "), family)).otherwise(family)

    return (F.when(name.rlike(r"\p{IsCyrillic}"), named("cyrillic")).when(name.rlike(r"\p{IsGreek}"), named("greek"))
            .otherwise(named("latin")))


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The canonical form of an entity's surrogate."""
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), canon), 256)
    domain = F.substring_index(canon, "@", -1)
    last = F.substring_index(domain, ".", -1)
    body = F.substr(canon, F.lit(1), F.length(canon) - F.length(last) - 1)
    number = F.concat(F.substring(canon, 1, 1), _chars(F.substr(canon, F.lit(2), F.length(canon) - 2), seed))
    country = F.substring_index(canon, "+", 1)
    local = F.substring_index(canon, "+", -1)
    octets = [(F.pmod(F.xxhash64(seed, F.lit(k)), F.lit(223 if k == 0 else 254)) + 1).cast("string") for k in range(4)]
    return (
        F.when(kind == "email", F.concat(_chars(body, seed), F.lit("."), last))
        .when(kind == "ip", F.concat_ws(".", *octets))
        .when(kind == "card", F.concat(number, _check_digit(number)))
        .when(kind == "phone", F.concat(country, F.lit("+"), F.element_at(F.array(*[F.lit(str(k)) for k in range(2, 10)]),
              (F.pmod(F.xxhash64(seed, F.lit(-1)), F.lit(8)) + 1).cast("int")), _chars(F.substr(local, F.lit(2)), seed)))
        .when(kind == "iban", _valid_iban(F.concat(F.substring(canon, 1, 4), _chars(F.substr(canon, F.lit(5)), seed))))
        .when((kind == "secret") & canon.startswith("AKIA"), F.concat(F.lit("AKIA"), _chars(F.substr(canon, F.lit(5)), seed)))
        .when(kind == "secret", _chars(canon, seed, canon.rlike("^[0-9a-f]+$")))
        .when(kind == "person", F.concat(F.substring(canon, 1, 2), _person(canon, seed, attempt)))
        .otherwise(_chars(canon, seed))
    )


def lengthened(kind: Column, canon: Column, new: Column, attempt: Column, key: str, by: int) -> Column:
    """A surrogate that is longer than its format by ``by`` digits (persons: syllables; IP addresses: a number more)."""
    seed = F.sha2(F.concat_ws("|", F.lit(key), F.lit("longer"), kind, attempt.cast("string"), canon), 256)
    draws = [F.xxhash64(seed, F.lit(k)) for k in range(by)]
    digits = F.concat(*(F.pmod(r, F.lit(10)).cast("string") for r in draws))
    number = F.concat(F.substr(new, F.lit(1), F.length(new) - 1), digits)

    def syllables(script: str) -> Column:
        return F.concat(*(_pick(SYLLABLES[script], r) for r in draws))

    return (
        F.when(kind == "email", F.regexp_replace(new, F.lit(r"(\.[^.]*)$"), F.concat(digits, F.lit("$1"))))
        .when(kind == "ip", F.concat(new, F.lit("."), digits))
        .when(kind == "card", F.concat(number, _check_digit(number)))
        .when(kind == "iban", _valid_iban(F.concat(new, digits)))
        .when(kind == "person", F.concat(new, F.when(new.rlike(r"\p{IsCyrillic}"), syllables("cyrillic")).when(
            new.rlike(r"\p{IsGreek}"), syllables("greek")).otherwise(syllables("latin"))))
        .otherwise(F.concat(new, digits))
    )


def written(kind: Column, value: Column, new: Column) -> Column:
    """A canonical surrogate in the form in which its entity was found."""
    plain = F.regexp_replace(new, r"\+", "")
    slots = F.split(value, "[0-9]", -1)
    digits = F.array_join(F.zip_with(slots, F.split(plain, ""), lambda a, b: F.concat(
        F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")  # a longer surrogate's last digits follow the form
    cased = F.array_join(F.zip_with(F.split(value, ""), F.split(new, ""), lambda a, b: F.when(
        a.rlike("[A-Z]"), F.upper(b)).otherwise(b)), "")
    blocks = F.regexp_replace(new, "(.{4})(?=.)", "$1 ")
    return (
        F.when(kind == "email", cased)
        .when(kind == "secret", F.concat(F.regexp_extract(value, _VALUE, 0), new))
        .when(kind.isin("phone", "ssn", "card"), digits)
        .when(kind == "iban", F.when(value.contains(" "), blocks).otherwise(new))
        .when(kind == "person", F.concat(F.regexp_extract(value, _TITLE, 0), F.substr(new, F.lit(3))))
        .otherwise(new)
    )


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, new): a surrogate for each different entity, none of them shared or an entity itself."""
    spark = entities.sparkSession
    real = entities.select("kind", F.col("canon").alias("new"))
    todo, done, paths = entities, None, []
    for attempt in count():
        new = surrogate(F.col("kind"), F.col("canon"), F.lit(attempt), key)
        if attempt >= ATTEMPTS:  # ever more room, so this ends
            new = lengthened(F.col("kind"), F.col("canon"), new, F.lit(attempt), key, LONGER * (attempt - ATTEMPTS + 1))
        drawn = todo.select("kind", "canon", new.alias("new"))
        first = drawn.groupBy("kind", "new").agg(F.min("canon").alias("canon"))  # of those that drew the same
        free = first.join(real, ["kind", "new"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "new"), ["kind", "new"], "left_anti")
        won, path = stored(spark, free.select("kind", "canon", "new"), "surrogates")
        done = won if done is None else done.unionByName(won)
        todo, path = stored(spark, todo.join(won, ["kind", "canon"], "left_anti"), "entities-without")
        paths.append(path)
        if todo.isEmpty():
            for p in paths:
                drop_path(spark, p)
            return done


#: The session's setting that names the key; surrogates of the key below can be told by anyone who has this file.
KEY_SETTING, UNSET_KEY = "spark.attrix.surrogateKey", "surrogate-key"


def replace_entities(docs: DataFrame, key: str | None = None, doc_col: str = "doc_id", text_col: str = "text") -> tuple:
    """The documents with surrogates in ``text_col`` (all columns kept), and a table of entities per changed document.

    The key is the one given, else that of the session's ``KEY_SETTING``.
    """
    spark = docs.sparkSession
    key = spark.conf.get(KEY_SETTING, UNSET_KEY) if key is None else key
    text, own = F.col(text_col), docs.columns
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    # names of our own that no column has
    tag = "_"
    while any(c.startswith(tag) for c in own):
        tag += "_"
    some = docs.select(F.col(doc_col).alias("d"), F.xxhash64(text).alias("h"), found.alias("m")).where(F.size("m") > 0)
    values = some.distinct().select("d", "h", F.explode(F.array_distinct("m")).alias("value"))
    values = values.withColumn("kind", kind_of(F.col("value"))).withColumn("canon", canonical(F.col("kind"), F.col("value")))
    values, values_path = stored(spark, values, "entity-values")
    entities, entities_path = stored(spark, values.select("kind", "canon").distinct(), "entities")
    given = assign(entities, key)
    rewritten = values.join(given, ["kind", "canon"]).select(
        "d", "h", F.struct("value", written(F.col("kind"), F.col("value"), F.col("new")).alias("new")).alias("pair"))
    maps, _ = stored(spark, rewritten.groupBy("d", "h").agg(F.map_from_entries(F.collect_list("pair")).alias("map")),
                     "entity-maps")
    drop_path(spark, entities_path)

    marked = docs.withColumn(f"{tag}has", F.coalesce(text.rlike(HINT) & text.rlike(PATTERN), F.lit(False)))
    plain = marked.where(~F.col(f"{tag}has")).drop(f"{tag}has")
    keyed = marked.where(F.col(f"{tag}has")).drop(f"{tag}has").withColumn(f"{tag}h", F.xxhash64(text))
    joined = keyed.join(maps.select(F.col("d").alias(f"{tag}d"), F.col("h").alias(f"{tag}k"), F.col("map").alias(f"{tag}map")),
                        F.col(doc_col).eqNullSafe(F.col(f"{tag}d")) & (F.col(f"{tag}h") == F.col(f"{tag}k")))
    news = F.transform(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), lambda v: F.element_at(F.col(f"{tag}map"), v))
    parts = F.zip_with(F.split(text, PATTERN, -1), news, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    changed = joined.withColumn(text_col, F.array_join(parts, "")).select(*own)
    return plain.unionByName(changed), values.select("d", "value", "kind")


def private_documents(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id and text with surrogates."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out, _ = replace_entities(base, key)
    return out
