"""Surrogates for personal data, in DataFrame operations only.

Entities are found by one pattern over the whole text.  Each is replaced by a keyed
surrogate of its own kind and format: every letter or digit by one of the same script and
case, drawn from SHA-256 over key, kind and entity (nested, as HMAC does), so without the
key nothing leads back.  Addresses of machines stay valid, card numbers keep the state of
their check digit, phones their country code, mail addresses their top-level domain.

Persons are replaced name by name, which keeps coreference: "Mr Otto Berg", "Mr Berg" and
a later plain "Otto Berg" in the same document share the surname's and the given name's
surrogate.  Given names keep gender (from the form of address) and script.

Entities are drawn apart over the whole corpus: where two would get the same surrogate, or
one would get a string that is itself an entity of the corpus, the later one gets further
attempts until all surrogates are distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import join_counted, stored

#: Forms of address by gender (``n`` tells none).
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Mme", "Mlle", "Sra", "Srta", "Signora", "г-жа"),
    "m": ("Mr", "Mister", "Herr", "Sr", "Signor", "г-н"),
    "n": ("Dr", "Prof", "Mx"),
}
#: Given names by gender and script.
GIVEN = {
    ("f", "latin"): "Alice Anna Clara Diana Elena Emma Eva Julia Laura Lena Maria Marta Nina Nora Olga Paula Rosa Sara Sofia Vera".split(),
    ("m", "latin"): "Adam Anton Bruno Carl David Emil Felix Hugo Ivan Jonas Karl Leon Lukas Marco Max Oscar Otto Paul Peter Victor".split(),
    ("n", "latin"): "Alex Andrea Dominique Jean Kim Luca Nicola Robin Sascha Toni".split(),
    ("f", "cyrillic"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга Софья Юлия".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Иван Кирилл Максим Олег Павел Юрий".split(),
    ("n", "cyrillic"): "Женя Саша Валя Слава Шура".split(),
}
#: Consonants, vowels and endings by gender of made-up given names.
SOUNDS = {"latin": ("bdfgklmnprstv", "aeiou", {"f": "a", "m": "n", "n": "e"}), "cyrillic": ("бвгдзклмнпрст", "аеиоу", {"f": "а", "m": "н", "n": "е"})}

#: What a letter or digit may become, by pattern: first code point and how many.
RANGES = (
    ("[0-9]", 0x30, 10),
    ("[a-z]", 0x61, 26),
    ("[A-Z]", 0x41, 26),
    (r"(?=\p{IsLatin})\p{Lu}", 0x41, 26),
    (r"\p{IsLatin}", 0x61, 26),
    (r"(?=\p{IsCyrillic})\p{Lu}", 0x410, 32),
    (r"\p{IsCyrillic}", 0x430, 32),
    (r"(?=\p{IsGreek})\p{Lu}", 0x391, 17),
    (r"\p{IsGreek}", 0x3B1, 17),
    (r"(?=\p{IsArmenian})\p{Lu}", 0x531, 38),
    (r"\p{IsArmenian}", 0x561, 38),
    (r"\p{IsGeorgian}", 0x10D0, 33),
    (r"\p{IsHebrew}", 0x5D0, 27),
    (r"\p{IsArabic}", 0x628, 19),
    (r"(?=\p{IsDevanagari})\p{L}", 0x915, 37),
    (r"(?=\p{IsThai})\p{L}", 0xE01, 46),
    (r"\p{IsHiragana}", 0x304B, 60),
    (r"\p{IsKatakana}", 0x30AB, 60),
    (r"\p{IsHangul}", 0xAC00, 11_172),
    (r"\p{IsHan}", 0x4E00, 20_902),
)

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NAME = r"(?:(?:\p{Lu}['’])?\p{Lu}[\p{L}\p{M}]{1,40}(?:-\p{Lu}[\p{L}\p{M}]{1,40})?|(?=\p{Lo})[\p{L}\p{M}]{1,40})"
_TITLE = "|".join(t for ts in TITLES.values() for t in ts)

#: Patterns by kind, the first that fits counts.  Runs are bounded and may only begin where
#: a run does, so a very long text without spaces is still read in linear time.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "phone": r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\d+] ?)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.+-])\d{3}([.-])\d{3}\1\d{4}(?![\d-]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)(?:\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}|3\d{3}[ -]?\d{6}[ -]?\d{5})(?!\d)",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])",
    "person": rf"(?<!\p{{L}})(?:{_TITLE})\.? {_NAME}(?: {_NAME})?(?![A-Za-z0-9._%+-]{{0,64}}@)",  # a name that begins a mail address is the address's
}
OTHERS = "|".join(f"(?:{p})" for k, p in PATTERNS.items() if k != "person")
ANY = f"{OTHERS}|(?:{PATTERNS['person']})"


def kind_of(entity: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def keyed(key: str, *parts: Column) -> Column:
    """SHA-256 over key and parts, nested as in HMAC, as hexadecimal text."""
    message = F.concat_ws("\0", F.lit(key), *parts)
    return F.sha2(F.concat_ws("\0", F.lit(key), F.sha2(message.cast("binary"), 256)).cast("binary"), 256)


def number(seed: Column, i: Column) -> Column:
    """The i-th number, of 48 bits, that a seed gives."""
    return F.conv(F.left(F.sha2(F.concat_ws("\0", seed, i.cast("string")).cast("binary"), 256), F.lit(12)), 16, 10).cast("long")


def letter(code: Column) -> Column:
    """The character with a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def drawn_letter(was: Column, n: Column) -> Column:
    """A letter or digit of the same script and case, chosen by ``n``.  Letters of scripts
    that :data:`RANGES` lacks move among their eight neighbours; other characters stay."""
    code = F.ascii(was).cast("long")
    out = F.when(was.rlike(r"^[\p{L}\p{N}]$"), letter(code - code % 8 + n % 8)).otherwise(was)
    for pattern, first, size in reversed(RANGES):
        out = F.when(was.rlike(f"^(?:{pattern})$"), letter(F.lit(first) + n % size)).otherwise(out)
    return out


def drawn(text: Column, seed: Column, one=drawn_letter) -> Column:
    """A text with each of its characters drawn anew."""
    places = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(places, lambda i: one(F.substring(text, i, F.lit(1)), number(seed, i))), "")


def _hex_digit(was: Column, n: Column) -> Column:
    digit = F.lower(F.hex(n % 16))
    return F.when(was.rlike("[A-F]"), F.upper(digit)).otherwise(digit)


def _check_digit(digits: Column) -> Column:
    """The Luhn digit that goes after some digits."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        x = F.substring(digits, i, F.lit(1)).cast("int")
        return F.when((n - i) % 2 == 0, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x)

    whole = F.aggregate(F.transform(F.sequence(F.lit(1), n), worth), F.lit(0), lambda a, x: a + x)
    return F.pmod(-whole, F.lit(10))


def _with_digits(pattern: Column, digits: Column) -> Column:
    """``pattern`` with its digits replaced in turn."""

    def place(i: Column) -> Column:
        was = F.substring(pattern, i, F.lit(1))
        n = F.length(F.regexp_replace(F.left(pattern, i), "[^0-9]", ""))
        return F.when(was.rlike("[0-9]"), F.substring(digits, n, F.lit(1))).otherwise(was)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(pattern)), place), "")


def _syllable(seed: Column, consonants: str, vowels: str):
    def at(i: Column) -> Column:
        n = number(seed, i)
        first, second = (n % len(consonants)).cast("int") + 1, F.shiftright(n, 8) % len(vowels)
        return F.concat(F.substring(F.lit(consonants), first, F.lit(1)), F.substring(F.lit(vowels), second.cast("int") + 1, F.lit(1)))

    return at


def _given(entity: Column, gender: Column, attempt: Column, seed: Column) -> Column:
    """A given name of the same gender and script: from the lists at first, then made up,
    longer with each attempt."""
    out = drawn(entity, seed)
    for script, (consonants, vowels, endings) in SOUNDS.items():
        for g, end in endings.items():
            names = GIVEN[g, script]
            listed = F.get(F.array(*map(F.lit, names)), (number(seed, F.lit(0)) % len(names)).cast("int"))
            made = F.initcap(F.concat(F.array_join(F.transform(F.sequence(F.lit(1), attempt), _syllable(seed, consonants, vowels)), ""), F.lit(end)))
            fits = entity.rlike(rf"^\p{{Is{script.capitalize()}}}") & (gender == g)
            out = F.when(fits, F.when(attempt < 2, listed).otherwise(made)).otherwise(out)
    return out


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``kind, entity, n, attempt, s`` for each row of ``kind, entity, n, attempt``.

    Kinds are those of :data:`PATTERNS` but for persons, whose names are ``surname`` or
    ``given-f``, ``given-m``, ``given-n``.  Equal rows give equal surrogates; other columns
    are dropped, an empty table gives an empty table, and a null entity a null surrogate.
    """
    if not key:
        raise ValueError("surrogates need a key that is not empty")
    kind, e, attempt = F.col("kind"), F.col("entity"), F.col("attempt")
    df = entities.select("kind", "entity", "n", "attempt", keyed(key, kind, attempt.cast("string"), e).alias("seed"))
    longer = F.greatest(attempt - 3, F.lit(0))  # where short ones run out
    code, top = F.regexp_extract(e, r"^\+\d{1,3}(?=[ .(-])", 0), F.regexp_extract(e, r"\.[A-Za-z]+$", 0)
    digits = F.regexp_replace(e, "[^0-9]", "")
    body = (
        F.when(kind == "phone", F.right(e, F.length(e) - F.length(code)))
        .when(kind == "email", F.concat(F.repeat(F.lit("a"), longer), F.left(e, F.length(e) - F.length(top))))
        .when(kind == "card", F.left(digits, F.length(digits) - 1))
        .when(kind == "surname", F.concat(e, F.repeat(F.right(e, F.lit(1)), longer)))
        .when(kind.isin("ip", "secret"), F.lit(""))
        .otherwise(e)
    )
    df = df.select("*", body.alias("body"), code.alias("code"), top.alias("top"), digits.alias("digits"))
    seed = F.col("seed")
    df = df.withColumn("out", drawn(F.col("body"), seed))
    n = F.length("digits")
    off = F.right("digits", F.lit(1)).cast("int") - _check_digit(F.left("digits", n - 1))
    octets = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (number(seed, i) % 254 + 1).cast("string")), ".")
    s = (
        F.when(kind == "ip", octets)
        .when(kind == "secret", drawn(e, seed, _hex_digit))
        .when(kind == "card", _with_digits(e, F.concat("out", F.pmod(_check_digit(F.col("out")) + off, F.lit(10)).cast("string"))))
        .when(kind == "phone", F.concat("code", "out"))
        .when(kind == "email", F.concat("out", "top"))
        .when(kind.startswith("given"), _given(e, F.right(kind, F.lit(1)), attempt, seed))
        .otherwise(F.col("out"))
    )
    return df.select("kind", "entity", "n", "attempt", s.alias("s"))


def distinct_surrogates(entities: DataFrame, key: str, rounds: int = 24) -> DataFrame:
    """``kind, entity, n, s`` with a surrogate of its own for each row of distinct ``kind,
    entity, n``.

    Where surrogates meet, the smallest entity keeps it and the others try again; so does
    one whose surrogate is an entity of the table (for given names, only its own entity:
    they are shared by many and tell nobody apart).  A corpus for which ``rounds`` don't
    suffice is refused.  An empty table gives an empty table; ``n`` is passed on.
    """
    made = stored(surrogates(entities.withColumn("attempt", F.lit(0)), key), "surrogates")
    real = entities.select(F.col("entity").alias("s")).distinct()
    me = F.struct("kind", "entity")
    for _ in range(rounds):
        met = made.groupBy("s").agg(F.min(me).alias("keeps"), F.count(F.lit(1)).alias("times")).filter("times > 1")
        clash = made.join(met, "s").filter(me != F.col("keeps")).select("kind", "entity", "n", "attempt")
        taken = made.filter(~F.col("kind").startswith("given")).join(real, "s", "left_semi").select("kind", "entity", "n", "attempt")
        own = made.filter("s = entity").select("kind", "entity", "n", "attempt")
        again = stored(clash.unionByName(taken).unionByName(own).distinct().withColumn("attempt", F.col("attempt") + 1), "again")
        if again.isEmpty():
            return made.select("kind", "entity", "n", "s")
        rest = made.join(again.select("kind", "entity"), ["kind", "entity"], "left_anti")
        made = stored(rest.unionByName(surrogates(again, key)), "surrogates")
    raise ValueError("surrogates still meet: their formats hold too few for this corpus")


def _names(persons: DataFrame) -> DataFrame:
    """``id, mark, entity, kind`` for each name of the persons of a document: the last is
    the surname, one before it a given name.  A name that is both counts as a surname."""
    words = F.split("entity", " ")
    title = F.regexp_replace(F.get(words, F.lit(0)), r"\.$", "")
    gender = F.when(title.isin(*TITLES["f"]), "f").when(title.isin(*TITLES["m"]), "m").otherwise("n")
    names = F.slice(words, F.lit(2), F.size(words) - 1)
    each = persons.select("id", "mark", gender.alias("g"), F.size(names).alias("size"), F.posexplode(names).alias("place", "name"))
    kind = F.when(F.col("place") == F.col("size") - 1, F.lit("surname")).otherwise(F.concat(F.lit("given-"), "g"))
    one = F.min(F.struct((kind != "surname").alias("later"), kind.alias("kind")))
    return each.groupBy("id", "mark", F.col("name").alias("entity")).agg(one.alias("as")).select("id", "mark", "entity", "as.kind")


def replace_entities(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts with their entities replaced: ``doc_id, n_entities, kinds, text``.

    ``n_entities`` counts the entities found, further mentions of a person's names not
    counted; ``kinds`` lists their kinds, distinct, sorted and joined by commas.  What lies
    between entities stays as it is, and a text without any is unchanged.  A null text
    stays null with no entities; long texts are read whole.  Repeated rows and null
    identifiers pass through; an empty table gives an empty table; other columns are not
    read.  Equal entities have equal surrogates over the whole table.  The key must not be
    empty; it stands in the query plan, so logs of plans are as secret as the key.

    Texts are matched once, and what was found is written beside them.
    """
    if not key:
        raise ValueError("surrogates need a key that is not empty")
    text = docs[text_col]
    rows = stored(
        docs.select(docs[id_col].alias("id"), text.alias("text"), F.xxhash64(text).alias("mark"), F.coalesce(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), F.array().cast("array<string>")).alias("entities")),
        "entities",
    )
    some = rows.filter("size(entities) > 0")
    held = some.select("id", "mark", F.explode(F.array_distinct("entities")).alias("entity")).select("*", kind_of(F.col("entity")).alias("kind"))
    each = held.filter("kind <> 'person'").select("id", "mark", "entity", "kind").distinct().unionByName(_names(held.filter("kind = 'person'")))
    each = stored(each.withColumn("what", F.concat_ws(":", "kind", "entity")), "mentions")
    made = distinct_surrogates(each.groupBy("kind", "entity").agg(F.count(F.lit(1)).alias("n")), key)
    made = stored(made.select(F.concat_ws(":", "kind", "entity").alias("what"), "n", "s"), "made")
    named = F.col("kind").startswith("given") | (F.col("kind") == "surname")
    longest = F.array_sort(F.collect_list(F.when(named, F.struct((-F.length("entity")).alias("size"), "entity"))))
    maps = join_counted(each, made, "what", "n").groupBy("id", "mark").agg(
        F.map_from_entries(F.collect_list(F.struct("entity", "s"))).alias("put"),
        F.array_join(F.array_sort(F.collect_set(F.when(named, F.lit("person")).otherwise(F.col("kind")))), ",").alias("kinds"),
        F.array_join(F.transform(longest, lambda x: x["entity"]), "|").alias("names"),
    )
    a, b = some.alias("a"), maps.alias("b")
    both = a.join(b, F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.mark") == F.col("b.mark"))).select("a.id", "a.text", "a.entities", "b.put", "b.kinds", "b.names")

    def put(between: Column, entity: Column) -> Column:
        return F.concat(between, F.coalesce(F.try_element_at("put", entity), F.lit("")))

    def replaced(pattern: Column) -> Column:
        return F.array_join(F.zip_with(F.split("text", pattern, -1), F.regexp_extract_all("text", pattern, F.lit(0)), put), "")

    mentions = F.concat(F.lit(OTHERS + r"|(?<![\p{L}\p{M}])(?:"), "names", F.lit(r")(?![\p{L}\p{M}])"))
    new = F.when(F.col("names") == "", replaced(F.lit(OTHERS))).otherwise(replaced(mentions))
    changed = both.select("id", F.size("entities").cast("long").alias("n_entities"), "kinds", new.alias("text"))
    plain = rows.filter("size(entities) = 0").select("id", F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("kinds"), "text")
    return plain.unionByName(changed).withColumnRenamed("id", id_col)
