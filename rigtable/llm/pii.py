"""Personal data replaced by keyed surrogates of the same type and format.

Entities are found by one pattern of alternatives; an entity's canonical form ignores its writing (case, the
signs between digits), so one person or number has one surrogate wherever and however it is written.  A
surrogate is drawn from a keyed hash of type and canonical form, class by class: a digit gives a digit, a capital
a capital, separators stay; a card number keeps its first digit and a valid check digit, a phone number its
country code, a key its prefix, an address lies below example.net.  A titled name keeps its title; given and
family names are entities of their own, built from syllables of the same script, the given name with an ending
of the title's gender, so "Mr A B" and "Mr B" keep the family in common.

Surrogates are checked over the whole corpus: two entities of a type never share one, and none equals an entity
that occurs; who loses draws again, until no clash is left.  Everything is DataFrame expressions; a document
without an entity is only scanned.

Null text stays null, with n_replaced 0.  Other columns are untouched, also where their names equal those used
here.  Repeated rows get the same replacements.  Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rigtable.llm.common import stage

#: Patterns of the entity types, in order of precedence.
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
MALE = r"Mr|Herrn?|Monsieur|Señor|Sr|Sir|Lord|Господин|господин"
FEMALE = r"Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Señorita|Lady|Госпожа|госпожа"
NEUTRAL = r"Dr|Prof"
NAME = r"\p{Lu}[\p{L}'’-]+"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])",
    "secret": r"(?i:(?<![a-z])(?:password|passwd|secret|token|api_?key)\s?[=:]\s?[\"']?)[A-Za-z0-9/+_-]{8,}|(?<![A-Za-z0-9])(?=[a-f]*\d)[0-9a-f]{40}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)",
    "phone": r"(?<![\w+])\+\d{1,3}(?:[ .-]?\(\d{1,5}\))?(?:[ .-]?\d{2,5}){2,5}(?!\d)|(?<!\w)\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\w-])\d{3}-\d{3}-\d{4}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "name": rf"(?<![\p{{L}}])(?:{MALE}|{FEMALE}|{NEUTRAL})\.? {NAME}(?: {NAME})?",
}
#: No entity begins inside a word: most places fail at the first test.
ANY = "(?<![A-Za-z0-9])(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
#: What every entity without a digit holds one of: an address or assignment sign, a key's prefix or a title (the shorter where one begins another).
SIGNS = ("@", "=", ":", "AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "Mr", "Ms", "Miss", "Frau", "Herr", "Monsieur", "Madame", "Mme", "Señor", "Sr", "Sir", "Lord", "Lady", "Dr", "Prof", "осподин", "оспожа")
#: Country codes of the numbering plan: those of one digit, of two, and else of three.
DIALLING = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}"
DIGITS = ("phone", "ssn", "card")
SYLLABLES = {
    "latin": "ba be bo da de di do fa fe ga go ka ke ko la le li lo ma me mi mo na ne ni no pa po ra re ri ro sa se si so ta te ti to va ve vi vo".split(),
    "cyrillic": "ба бе бо да де ди до га го ка ке ко ла ле ли ло ма ме ми мо на не ни но па по ра ре ри ро са се си со та те ти то ва ве ви во".split(),
}
ENDINGS = {
    ("latin", "m"): "n s rt lf".split(), ("latin", "f"): "na la ra sa".split(), ("latin", "n"): "l r m x".split(),
    ("cyrillic", "m"): "н р м в".split(), ("cyrillic", "f"): "на ла ра са".split(), ("cyrillic", "n"): "л р м т".split(),
}


def kind_of(entity: Column) -> Column:
    """The first type whose pattern an entity fits as a whole."""
    out = None
    for name, pattern in PATTERNS.items():
        fits = entity.rlike(f"^(?:{pattern})$")
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def drawn(state: DataFrame, key: str) -> DataFrame:
    """Adds ``n``, 32 keyed numbers from 0 to 65,535 for (kind, canonical, attempt), as a column: later expressions use it often."""
    named = F.concat_ws("\x1f", F.lit(key), "kind", "canonical", F.col("attempt").cast("string"))
    hashed = state.withColumn("hash", F.sha2(named, 512))
    return hashed.withColumn("n", F.array(*[F.conv(F.substring("hash", 4 * i + 1, 4), 16, 10).cast("int") for i in range(32)])).drop("hash")


def by_class(text: Column, numbers: Column, hexadecimal: Column) -> Column:
    """Every letter and digit replaced by one of its class; hexadecimal: letters stay below g."""

    def one(char: Column, i: Column) -> Column:
        n = F.get(numbers, i % 32)
        letters = F.when(hexadecimal, 6).otherwise(26)
        return (
            F.when(char.between("0", "9"), (n % 10).cast("string"))
            .when(char.between("a", "z"), F.char(97 + n % letters))
            .when(char.between("A", "Z"), F.char(65 + n % letters))
            .otherwise(char)
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def with_check_digit(number: Column) -> Column:
    """The number with its last digit set so that the card check sum holds."""
    body = F.split(F.reverse(F.substring(number, F.lit(1), F.length(number) - 1)), "")
    total = F.aggregate(
        F.transform(body, lambda d, i: F.when(i % 2 == 0, 2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int"))),
        F.lit(0), lambda a, x: a + x,
    )
    return F.concat(F.substring(number, F.lit(1), F.length(number) - 1), F.pmod(-total, F.lit(10)).cast("string"))


def surrogate(key: str) -> Column:
    """The surrogate of (kind, canonical) at an attempt with its numbers ``n``."""
    kind, canonical, attempt, n = F.col("kind"), F.col("canonical"), F.col("attempt"), F.col("n")
    plain = by_class(canonical, n, canonical.rlike("^[0-9a-f]+$"))
    local, domain = F.split_part(canonical, F.lit("@"), F.lit(1)), F.split_part(canonical, F.lit("@"), F.lit(2))
    host = F.concat(F.lit("m"), F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("domain"), domain), 256), 1, 6), F.lit(".example.net"))
    email = F.concat(by_class(local, n, F.lit(False)), F.when(attempt > 3, attempt.cast("string")).otherwise(""), F.lit("@"), host)
    ip = F.array_join(F.transform(F.split(canonical, "\\."), lambda x, i: (1 + F.get(n, i) % 254).cast("string")), ".")
    token = F.concat(F.substring(canonical, 1, 4), by_class(F.substring(canonical, F.lit(5), F.length(canonical)), n, F.lit(False)))
    card = F.concat(F.substring(canonical, 1, 1), F.substring(plain, F.lit(2), F.length(plain)))
    country = F.split_part(canonical, F.lit("|"), F.lit(1))
    phone = F.concat(country, F.lit("|"), F.regexp_replace(by_class(F.split_part(canonical, F.lit("|"), F.lit(2)), n, F.lit(False)), "^0", "7"))
    iban = F.concat(F.substring(canonical, 1, 2), F.substring(plain, F.lit(3), F.length(plain)))
    name = None
    for (script, gender), endings in ENDINGS.items():
        parts = F.array_join(F.transform(F.sequence(F.lit(0), 1 + attempt), lambda i: F.get(F.array(*map(F.lit, SYLLABLES[script])), F.get(n, i % 31) % len(SYLLABLES[script]))), "")
        whole = F.concat(parts, F.get(F.array(*map(F.lit, endings)), F.get(n, F.lit(31)) % len(endings)))
        fits = kind.like(f"%name {gender} {script}")
        name = F.when(fits, whole) if name is None else name.when(fits, whole)
    return (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "key", token).when(kind == "card", with_check_digit(card))
        .when(kind == "phone", phone).when(kind == "iban", iban).when(kind.like("%name %"), name).otherwise(plain)
    )


def entity_parts(found: Column) -> Column:
    """The parts of an entity that are replaced: array of (kind, canonical, original), and the text before each."""
    kind, value = found["kind"], found["value"]
    secret = F.regexp_extract(value, r"([A-Za-z0-9/+_-]{8,})$", 1)
    country = F.when(value.startswith("+"), F.regexp_extract(digits(value), rf"^({DIALLING})", 1)).otherwise("")
    canonical = (
        F.when(kind == "email", F.lower(value)).when(kind.isin("ssn", "card"), digits(value)).when(kind == "secret", secret)
        .when(kind == "phone", F.concat(country, F.lit("|"), F.substring(digits(value), F.length(country) + 1, F.length(value))))
        .when(kind == "iban", F.replace(value, F.lit(" "), F.lit(""))).otherwise(value)
    )
    lead = F.when(kind == "secret", F.substring(value, F.lit(1), F.length(value) - F.length(secret))).otherwise("")
    single = F.array(F.struct(kind.alias("kind"), canonical.alias("canonical"), F.when(kind == "secret", secret).otherwise(value).alias("original"), lead.alias("lead")))
    words = F.split(value, " ")
    title = F.get(words, F.lit(0))
    gender = F.when(title.rlike(rf"^(?:{MALE})\.?$"), "m").when(title.rlike(rf"^(?:{FEMALE})\.?$"), "f").otherwise("n")

    def part(word: Column, role: str, lead: Column, gender: Column) -> Column:
        script = F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
        return F.struct(F.concat(F.lit(role + " "), gender, F.lit(" "), script).alias("kind"), F.lower(word).alias("canonical"), word.alias("original"), lead.alias("lead"))

    family = part(F.element_at(words, -1), "family name", F.when(F.size(words) > 2, " ").otherwise(F.concat(title, F.lit(" "))), F.lit("n"))
    names = F.when(F.size(words) > 2, F.array(part(F.get(words, F.lit(1)), "given name", F.concat(title, F.lit(" ")), gender), family)).otherwise(F.array(family))
    return F.when(kind == "name", names).otherwise(single)


def rendered(kind: Column, original: Column, replacement: Column) -> Column:
    """A surrogate in the writing of the original."""
    number = digits(replacement)

    def place(char: Column, i: Column) -> Column:
        before = F.length(digits(F.substring(original, F.lit(1), i)))
        return F.when(char.between("0", "9"), F.substring(number, before + 1, F.lit(1))).otherwise(char)

    in_digits = F.array_join(F.transform(F.split(original, ""), place), "")
    bare = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    in_groups = F.array_join(F.transform(F.split(original, ""), lambda c, i: F.when(c == " ", c).otherwise(F.substring(replacement, F.length(bare(F.substring(original, F.lit(1), i))) + 1, F.lit(1)))), "")
    cased = F.when((original == F.upper(original)) & (F.length(original) > 1), F.upper(replacement))
    return (
        F.when(kind.isin(*DIGITS), in_digits).when(kind == "iban", in_groups).when(kind == "email", cased.otherwise(replacement))
        .when(kind.like("%name %"), cased.otherwise(F.initcap(replacement))).otherwise(replacement)
    )


def assign(entities: DataFrame, key: str) -> DataFrame:
    """Rows (kind, canonical, surrogate), surrogates distinct within a kind and from all entities; entities: distinct kind, canonical."""
    first_draw = drawn(entities.withColumn("attempt", F.lit(0)), key).withColumn("surrogate", surrogate(key)).drop("n")
    state = stage(first_draw.withColumn("settled", F.lit(False)), "surrogates")
    taken = entities.select("kind", F.col("canonical").alias("surrogate"))
    while True:
        first = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy(F.col("settled").desc(), "canonical")) == 1
        real = taken.withColumn("real", F.lit(True))
        state = state.withColumn("first", first).join(real, ["kind", "surrogate"], "left").withColumn("settled", F.col("first") & F.col("real").isNull()).drop("first", "real")
        state = stage(state, "surrogates")
        if state.where("NOT settled").isEmpty():
            return state.select("kind", "canonical", "surrogate")
        state = state.withColumn("attempt", F.when(F.col("settled"), F.col("attempt")).otherwise(F.col("attempt") + 1))
        state = drawn(state, key).withColumn("surrogate", F.when(F.col("settled"), F.col("surrogate")).otherwise(surrogate(key))).drop("n")


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """All rows and columns of docs with entities of the text replaced, and ``n_replaced`` (in place of any column so named)."""
    kept = [c for c in docs.columns if c != "n_replaced"]
    rows = docs.select(F.struct(*kept).alias("row"), F.col(text_col).alias("body"))
    # Plain searches rule most documents out; only the others are tried against the patterns.
    maybe = F.col("body").rlike("[0-9]")
    for sign in SIGNS:
        maybe = maybe | F.contains("body", F.lit(sign))
    maybe = F.coalesce(maybe, F.lit(False))

    def out(rows: DataFrame, body: Column, n: Column) -> DataFrame:
        columns = [body.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in kept]
        return rows.select(*columns, n.cast("long").alias("n_replaced"))

    # Matches of a document with the text before each, and the rest; ids are stable because the rows are staged.
    hits = stage(rows.where(maybe).select(
        F.monotonically_increasing_id().alias("hit"), "row", F.split("body", ANY, -1).alias("between"), F.regexp_extract_all("body", F.lit(ANY), F.lit(0)).alias("matches")
    ), "pii-hits")
    found = hits.select("hit", F.posexplode("matches").alias("at", "value")).withColumn("kind", kind_of(F.col("value")))
    parts = stage(found.select("hit", "at", F.posexplode(entity_parts(F.struct("kind", "value"))).alias("part", "entity")).select("hit", "at", "part", "entity.*"), "pii-entities")
    surrogates = assign(parts.select("kind", "canonical").distinct(), key)
    written = parts.join(surrogates, ["kind", "canonical"]).select(
        "hit", F.struct("at", "part", F.concat("lead", rendered(F.col("kind"), F.col("original"), F.col("surrogate"))).alias("text")).alias("piece")
    )
    fixes = written.groupBy("hit").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))  # entities of one document
    joined = hits.join(fixes, "hit", "left").withColumn("pieces", F.coalesce("pieces", F.array().cast(fixes.schema["pieces"].dataType)))
    replaced = F.transform("between", lambda x, i: F.concat(x, F.array_join(F.transform(F.filter("pieces", lambda p: p["at"] == i), lambda p: p["text"]), "")))
    changed = out(joined, F.array_join(replaced, ""), F.size("matches"))
    return out(rows.where(~maybe), F.col("body"), F.lit(0)).unionByName(changed)
