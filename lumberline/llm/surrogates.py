"""Personal data replaced by keyed surrogates of the same type and format.

Mentions are found by one regular expression. A mention's entity is its type and
normal form (digits of a number, lower-case address, part of a name with its gender and
script), so all mentions of an entity, in whatever format, get the same surrogate. The
distinct entities draw surrogates from a keyed hash; draws that meet another entity's
surrogate, or a value that is in the texts, are drawn again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumberline.llm.store import stored

# What is looked for, in this order at equal places.
# An address begins where its run of letters does, or where the match before it ended; no group is
# repeated, so that long runs and long domains take linear time and no depth of the stack.
_EMAIL = r"(?:(?<![\p{L}\p{N}._%+-])|\G)[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-][\p{L}\p{N}.-]*\.\p{L}{2,}"
_ADDRESS = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"
_CARD = r"(?<!\d)\d{4}(?:([ -]?)\d{4}){3}(?!\d)"
_PHONE = r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)"
MALE = ("Mr", "Herr", "Monsieur", "Sr", "Señor")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Sra", "Señora")
_WORD = r"\p{Lu}[\p{L}'’-]*\p{L}"  # with O'Neil and Anna-Maria
_NAME = rf"(?<!\p{{L}})(?:{'|'.join(MALE + FEMALE)})\.? {_WORD}(?: {_WORD})?"
# Country codes of one and two digits; the others have three.
_CODE = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
MENTION = f"{_EMAIL}|{_ADDRESS}|{_CARD}|{_PHONE}|{_NAME}"
# Syllables of made-up names by script, and their endings by gender (m, f, none).
SYLLABLES = {
    "latin": ("ba", "do", "fe", "ki", "lo", "ma", "ne", "pi", "ra", "su", "te", "vi", "za", "ho", "ge", "ju"),
    "cyrillic": ("ба", "до", "фе", "ки", "ло", "ма", "не", "пи", "ра", "су", "те", "ви", "за", "хо", "ге", "жу"),
    "greek": ("βα", "δο", "φε", "κι", "λο", "μα", "νε", "πι", "ρα", "συ", "τε", "βι", "ζα", "χο", "γε", "ξυ"),
}
ENDINGS = {"latin": ("rik", "lina", "sen"), "cyrillic": ("рик", "лина", "сен"), "greek": ("ρικ", "λινα", "σεν")}
_ROW = ["_id", "_hash"]


def _kind(mention: Column) -> Column:
    return (
        F.when(F.contains(mention, F.lit("@")), "email").when(mention.rlike(f"^(?:{_ADDRESS})$"), "address")
        .when(mention.rlike(f"^(?:{_CARD})$"), "card").when(mention.rlike(r"^[+(\d]"), "phone").otherwise("name")
    )


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def parts_of(mention: Column) -> Column:
    """The entities that a mention names: array of (type, normal form)."""
    part = lambda kind, form: F.struct(F.lit(kind).alias("type") if isinstance(kind, str) else kind.alias("type"), form.alias("form"))
    kind = _kind(mention)
    words = F.split(mention, " ")
    gender = F.when(F.regexp_replace(words[0], r"\.", "").isin(*MALE), "m").otherwise("f")
    given = part(F.concat(F.lit("given_"), gender), F.lower(words[1]))
    family = F.array(part("family", F.lower(F.element_at(words, -1))))
    names = F.when(F.size(words) > 2, F.concat(F.array(given), family)).otherwise(family)
    number = F.array(part(kind, F.when(kind == "email", F.lower(mention)).when(kind == "address", mention).otherwise(F.concat(F.regexp_extract(mention, r"^\+?", 0), _digits(mention)))))
    return F.when(kind == "name", names).otherwise(number)


def _hash_digits(key: str, attempt: str = "attempt", size: int = 128) -> Column:
    """Decimal digits from the keyed hash of an entity; each letter of two hashes becomes a digit."""
    seed = F.concat_ws("\x1f", F.lit(key), "type", "form", F.col(attempt).cast("string"))
    return F.translate(F.concat(*[F.sha2(F.concat(seed, F.lit(f"\x1f{i}")), 256) for i in range(size // 64)]), "abcdef", "036147")


def _at(digits: Column, i: Column | int, width: int = 1) -> Column:
    return F.substring(digits, (i if isinstance(i, Column) else F.lit(i)) + 1, F.lit(width))


def _filled(form: Column, digits: Column) -> Column:
    """The form with its letters and digits exchanged for others of their class, one hash digit pair each."""
    latin, cyrillic, greek = F.lit("abcdefghijklmnopqrstuvwxyz"), F.lit("абвгдежзиклмнопрстуфхцчшщэюя"), F.lit("αβγδεζηθικλμνξοπρστυφχψω")

    def of(c: Column, i: Column) -> Column:
        n = _at(digits, (i * 2) % 126, 2).cast("int")
        pick = lambda letters, size: F.substring(letters, n % size + 1, F.lit(1))
        return (
            F.when(c.rlike(r"\d"), (n % 10).cast("string")).when(c.rlike(r"\p{IsCyrillic}"), pick(cyrillic, 28))
            .when(c.rlike(r"\p{IsGreek}"), pick(greek, 24)).when(c.rlike(r"\p{L}"), pick(latin, 26)).otherwise(c)
        )

    return F.array_join(F.transform(F.split(form, ""), of), "")


def _drawn(key: str, attempt: int) -> Column:
    """The surrogate's normal form for (type, form, attempt). Names grow by a syllable with each attempt."""
    digits, form = _hash_digits(key), F.col("form")
    local, domain = F.substring_index(form, "@", 1), F.substring_index(form, "@", -1)
    top = F.substring_index(domain, ".", -1)
    email = F.concat(_filled(local, digits), F.lit("@"), _filled(F.substring(domain, F.lit(1), F.length(domain) - F.length(top) - 1), F.reverse(digits)), F.lit("."), top)
    octets = F.concat_ws(".", *[(_at(digits, 4 * i, 4).cast("int") % 254 + 1).cast("string") for i in range(4)])
    number = _filled(form, digits)
    # The country stays; of a number without one, the first digit.
    country = F.regexp_extract(form, rf"{_CODE}|^\d", 0)
    phone = F.concat(country, F.substring(number, F.length(country) + 1, F.length(number)))
    # A card number that passes the check-digit test keeps passing it.
    card = F.concat(F.substring(number, 1, 15), _check_digit(F.substring(number, 1, 15)))
    card = F.when(F.substring(form, -1, 1) == _check_digit(F.substring(form, 1, 15)), card).otherwise(number)
    script = F.when(form.rlike(r"\p{IsCyrillic}"), "cyrillic").when(form.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")

    def name(which: str) -> Column:
        table = F.array(*map(F.lit, SYLLABLES[which]))
        syllables = [table[_at(digits, 4 * i, 4).cast("int") % 16] for i in range(min(3 + attempt, 32))]  # as many as there are digits for
        end = F.when(F.col("type") == "given_m", ENDINGS[which][0]).when(F.col("type") == "given_f", ENDINGS[which][1]).otherwise(ENDINGS[which][2])
        return F.concat(*syllables, end)

    names = F.when(script == "cyrillic", name("cyrillic")).when(script == "greek", name("greek")).otherwise(name("latin"))
    kind = F.col("type")
    return F.when(kind == "email", email).when(kind == "address", octets).when(kind == "card", card).when(kind == "phone", phone).otherwise(names)


def _check_digit(number: Column) -> Column:
    """The Luhn check digit of 15 digits."""
    doubled = F.transform(F.split(number, ""), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    total = F.aggregate(doubled, F.lit(0), lambda n, x: n + F.coalesce(x, F.lit(0)))
    return ((10 - total % 10) % 10).cast("string")


def assign_surrogates(entities: DataFrame, key: str, rounds: int = 40) -> DataFrame:
    """``type, form, surrogate`` for distinct (type, form) rows; surrogates of a type are distinct.

    In each round the open entities draw. Of those that draw the same, the first by form
    takes it, unless it is taken, or is a form in the texts; the others draw again.
    """
    entities = stored(entities.select("type", "form").distinct(), "entities")
    settled = entities.filter("false").withColumn("surrogate", F.lit(""))
    open_ = entities
    for attempt in range(rounds):
        drawn = open_.withColumn("attempt", F.lit(attempt)).withColumn("surrogate", _drawn(key, attempt)).drop("attempt")
        taken = entities.select("type", F.col("form").alias("surrogate")).unionByName(settled.select("type", "surrogate")).distinct()
        rank = F.row_number().over(Window.partitionBy("type", "surrogate").orderBy("form"))
        judged = drawn.withColumn("rank", rank).join(taken.withColumn("taken", F.lit(True)), ["type", "surrogate"], "left")
        judged = stored(judged.withColumn("good", (F.col("rank") == 1) & F.col("taken").isNull()).select("type", "form", "surrogate", "good"), "draws")
        settled = settled.unionByName(judged.filter("good").drop("good"))
        open_ = judged.filter("not good").select("type", "form")
        if open_.isEmpty():
            return settled
    raise RuntimeError(f"{open_.count()} entities have no distinct surrogate after {rounds} rounds: lengthen the formats")


def _formatted(mention: Column, surrogates: Column) -> Column:
    """A mention written with the surrogates of its parts, in its own format."""
    kind, first = _kind(mention), F.ltrim(surrogates[0], F.lit("+"))
    start = F.struct(F.lit(0).alias("i"), F.lit("").alias("out"))

    def put(acc: Column, c: Column) -> Column:
        digit = c.rlike(r"\d")
        out = F.concat(acc["out"], F.when(digit, F.substring(first, acc["i"] + 1, F.lit(1))).otherwise(c))
        return F.struct((acc["i"] + digit.cast("int")).alias("i"), out.alias("out"))

    number = F.aggregate(F.split(mention, ""), start, put)["out"]
    words = F.split(mention, " ")

    def cased(new: Column, old: Column) -> Column:
        return F.when(old == F.upper(old), F.upper(new)).otherwise(F.initcap(new))

    names = F.array_join(F.concat(F.array(words[0]), F.zip_with(surrogates, F.slice(words, 2, F.size(surrogates)), cased)), " ")
    return F.when(kind.isin("email", "address"), first).when(kind == "name", names).otherwise(number)


def with_surrogates(docs: DataFrame, key: str) -> DataFrame:
    """The documents with every mention replaced, and ``n_replaced``; all other columns stay.

    NULL and empty texts stay as they are, as do texts without a mention. Rows that
    repeat id and text are replaced alike. A column called n_replaced is replaced.
    """
    docs = docs.drop("n_replaced")
    columns = docs.columns
    found = docs.withColumn("_found", F.regexp_extract_all(F.col("text").cast("string"), F.lit(MENTION), F.lit(0)))
    plain = found.filter(F.coalesce(F.size("_found") == 0, F.lit(True))).select(*columns, F.lit(0).alias("n_replaced"))
    named = found.filter(F.size("_found") > 0).withColumns({"_id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "_hash": F.sha2(F.col("text").cast("binary"), 256)})

    mentions = named.select(*_ROW, F.posexplode("_found").alias("_at", "mention"))
    parts = mentions.select(*_ROW, "_at", "mention", F.posexplode(parts_of(F.col("mention"))).alias("_part", "_entity")).select(*_ROW, "_at", "mention", "_part", "_entity.*")
    parts = stored(parts.distinct(), "mentions")
    surrogates = stored(assign_surrogates(parts, key), "surrogates")
    written = parts.join(surrogates, ["type", "form"]).groupBy(*_ROW, "_at", "mention").agg(F.array_sort(F.collect_list(F.struct("_part", "surrogate"))).alias("parts"))
    written = written.withColumn("new", _formatted(F.col("mention"), F.transform("parts", lambda p: p["surrogate"])))
    # A document's own mentions.
    new = written.groupBy(*_ROW).agg(F.array_sort(F.collect_list(F.struct("_at", "new"))).alias("_new"))
    between = F.split(F.col("text"), MENTION, -1)
    text = F.array_join(F.zip_with(between, F.transform("_new", lambda x: x["new"]), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    done = named.join(new, _ROW).withColumn("text", text).withColumn("n_replaced", F.size("_new"))
    return plain.unionByName(done.select(*columns, "n_replaced"))
