"""Personal data replaced by keyed, type-consistent surrogates.

Entities are found by one pattern. Each gets a surrogate drawn from a keyed digest of its type and canonical form, so
the same entity has the same surrogate in every document, however a number is written. Surrogates keep type and format: digits stay digits,
letters keep case and script, punctuation stays, card numbers keep their Luhn validity, names keep title, gender,
script and number of words, addresses stay addresses.

Collision check: all distinct entities of the corpus are drawn first. Where two of one type get the same surrogate,
or a surrogate equals an entity of the corpus, all but the smallest draw again, until none collide. Each further draw
lengthens names by a syllable and addresses and secrets by a letter, so their surrogates never run out; numbers keep
their length, and a corpus that leaves too few free numbers of a form is refused. Only documents with redrawn entities
need a lookup; all others are rewritten in place, without a shuffle of texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

KEY = "replace-this-key"
# a telephone number without its country code has at most so many digits
PHONE_DIGITS = 10
# draws in a row that settle no entity: its form has no free surrogate left
IDLE_DRAWS = 40

# fixed values: titles with the gender they show (Greek capitals drop the accent), and given and family names by script
MALE_TITLES = ["Mr", "Herr", "Monsieur", "Señor", "Signor", "господин", "κύριος", "κυριος"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Signora", "госпожа", "κυρία", "κυρια"]
NAMES = {
    ("latin", "male"): ["Adam", "Boris", "Carl", "David", "Emil", "Frank", "Georg", "Hugo", "Ivan", "Jonas", "Karl",
                        "Leon", "Martin", "Nils", "Oscar", "Paul"],
    ("latin", "female"): ["Anna", "Berta", "Clara", "Dora", "Emma", "Flora", "Greta", "Helen", "Irene", "Julia",
                          "Klara", "Laura", "Maria", "Nora", "Olga", "Paula"],
    ("latin", "family"): ["Alder", "Berg", "Castor", "Dahl", "Ebner", "Falk", "Gruber", "Holm", "Iversen", "Jansen",
                          "Keller", "Lund", "Moreno", "Novak", "Orlov", "Petit", "Quint", "Rossi", "Sander", "Thorn"],
    ("cyrillic", "male"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Павел"],
    ("cyrillic", "female"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Ольга"],
    ("cyrillic", "family"): ["Гончар", "Дорош", "Король", "Мельник", "Орлик", "Павленко", "Савчук", "Шевчук"],
    ("greek", "male"): ["Ανδρέας", "Γιώργος", "Νίκος", "Πέτρος"],
    ("greek", "female"): ["Άννα", "Ελένη", "Μαρία", "Σοφία"],
    ("greek", "family"): ["Βλάχος", "Δήμου", "Κωστής", "Μάνος", "Παππάς", "Ρήγας"],
}
# consonants and vowels of the syllables that further draws append to a family name
SYLLABLES = {
    "latin": ("bcdfghjklmnprstvwz", "aeiou"),
    "cyrillic": ("бвгджзклмнпрстфхцч", "аеиоу"),
    "greek": ("βγδζθκλμνξπρτφχψ", "αειου"),
}
# alphabets letters are drawn from: an input character in the class gives a character of the same class
ALPHABETS = [
    ("[0-9]", "0123456789"),
    ("[a-z]", "abcdefghijklmnopqrstuvwxyz"),
    ("[а-яё]", "абвгдежзийклмнопрстуфхцчшщэюя"),
    ("[α-ωάέήίόύώ]", "αβγδεζηθικλμνξοπρστυφχψω"),
    (r"[\p{IsLatin}]", "àáâäåæçèéêëìíîïñòóôöøùúûüýß"),
    (r"[\p{IsHan}]", "一二三四五六七八九十人大小上下天地日月山水火木金土"),
]

_WORD_BEFORE = r"(?<![\p{L}\p{N}])"
_TITLES = "|".join(MALE_TITLES + FEMALE_TITLES)
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]+(?:\.[\p{L}\p{N}\-]+)+",
    "assigned": _WORD_BEFORE + r"(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}"
                               r"[\"'][^\"'\s]{8,}[\"']",
    "secret": _WORD_BEFORE + r"(?:AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9]{20,}|"
                             r"(?=[0-9A-Fa-f]{0,31}[0-9])[0-9A-Fa-f]{32,})(?![\p{L}\p{N}])",
    "ip": r"(?<![\d.\p{L}])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\.?\d)",
    "card": r"(?<![\p{L}\d.+\-])\d(?:[ \-]?\d){12,18}(?![\p{L}\d])",
    "ssn": r"(?<![\p{L}\d.\-])\d{3}-\d{2}-\d{4}(?![\p{L}\d\-])",
    "phone": r"(?<![\p{L}\d.\-])1[ .\-]\d{3}[ .\-]\d{3}[ .\-]\d{4}(?!\d)|(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)|(?<![\p{L}\d.\-])\d{3})[ .\-]?\d{3}[ .\-]\d{4}(?!\d)"
             r"|\+\d{1,3}(?:[ .\-]?\d{2,4}){2,5}(?!\d)|(?<![\p{L}\d.\-])\d{3}-\d{4}(?![\d\-])",
    "name": _WORD_BEFORE + rf"(?iu:{_TITLES})\.?\s{{1,3}}\p{{Lu}}[\p{{L}}'\-]+(?:\s{{1,3}}\p{{Lu}}[\p{{L}}'\-]+){{0,2}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# what every entity holds: a cheap search that spares most texts the full pattern
MAYBE = r"[0-9@]|[=:]\s{0,3}[\"']|AKIA|gh[opsu]_|sk-|" + PATTERNS["name"]


def entity_type(value: Column) -> Column:
    """The first pattern that the whole value matches."""
    return F.coalesce(*[
        F.when(value.rlike(rf"^(?:{p})$"), F.lit(kind)) for kind, p in PATTERNS.items()], F.lit("card"))


def canonical(kind: Column, value: Column) -> Column:
    """What two mentions of one entity share: digits of numbers (of telephones without the country code, which may be
    left out), lower case of the rest, the quoted part of an
    assigned secret."""
    return (
        F.when(kind == "phone", F.right(F.regexp_replace(value, r"\D", ""), F.lit(PHONE_DIGITS)))
        .when(kind.isin("card", "ssn"), F.regexp_replace(value, r"\D", ""))
        .when(kind == "assigned", F.lower(F.regexp_extract(value, r"[\"']([^\"']*)[\"']$", 1)))
        .when(kind == "name", F.lower(F.regexp_replace(value, r"[.\s]+", " ")))
        .otherwise(F.lower(value)))


def _bound(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once and named, not written out wherever it is used: expressions that
    contain each other several times grow the plan, which the driver holds, by their product."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _draw(seed: Column, *place) -> Column:
    return F.pmod(F.xxhash64(seed, *place), F.lit(1 << 40))


def _pick(options: list[str], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (F.pmod(at, F.lit(len(options))) + 1).cast("int"))


def _recode(text: Column, seed: Column) -> Column:
    """Every letter and digit replaced by another of its class."""
    hexadecimal = text.rlike("^(?=.*[a-f])(?=.*[0-9])[0-9a-f]{16,}$")

    def one(c, at, hexadecimal):
        choice = F.when(hexadecimal, _pick(list("0123456789abcdef"), at))
        for cls, letters in ALPHABETS:
            choice = choice.when(c.rlike(cls), F.substring(F.lit(letters), F.pmod(at, F.lit(len(letters))).cast("int")
                                                           + 1, F.lit(1)))
        return choice.otherwise(c)

    return _bound(hexadecimal, lambda h: F.array_join(F.transform(F.split(text, ""), lambda c, i: _bound(
        _draw(seed, i), lambda at: one(c, at, h))), ""))


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum over all digits, the last one not doubled."""
    n = F.char_length(digits)
    # surrogates of other kinds may pass through here; what isn't a digit counts nothing
    values = F.transform(F.split(digits, ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    parts = F.transform(values, lambda d, i: F.when(
        F.pmod(n - i, F.lit(2)) == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.aggregate(parts, F.lit(0), lambda total, d: total + d)


def _card(canon: Column, seed: Column) -> Column:
    def checked(drawn):
        body = F.substring(drawn, F.lit(1), F.char_length(canon) - 1)
        check = F.pmod(10 - F.pmod(_luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
        return F.when(F.pmod(_luhn_sum(canon), F.lit(10)) == 0, F.concat(body, check.cast("string"))).otherwise(drawn)

    return _bound(_recode(canon, seed), checked)


def _longer(text: Column, draw: Column) -> Column:
    """A letter more per further draw."""
    return F.concat(text, F.repeat(F.lit("a"), draw))


def _email(canon: Column, seed: Column, draw: Column) -> Column:
    """The last label of the domain stays."""
    ending = F.regexp_extract(canon, r"(\.[^.]+)$", 1)
    return F.concat(_recode(_longer(F.regexp_replace(canon, r"\.[^.]+$", ""), draw), seed), ending)


def _syllables(script: str, seed: Column, draw: Column) -> Column:
    """Nothing at the first draw, two syllables at the second, one more at each further one."""
    consonants, vowels = SYLLABLES[script]
    return F.when(draw > 0, F.array_join(F.transform(F.sequence(F.lit(0), draw), lambda i: F.concat(
        _pick(list(consonants), _draw(seed, F.lit("consonant"), i)),
        _pick(list(vowels), _draw(seed, F.lit("vowel"), i)))), "")).otherwise(F.lit(""))


def _name(canon: Column, seed: Column, draw: Column) -> Column:
    title = F.substring_index(canon, " ", 1)
    words = F.slice(F.split(canon, " "), F.lit(2), F.size(F.split(canon, " ")))
    female = title.isin(*[F.lower(F.lit(t)) for t in FEMALE_TITLES])
    rest = F.array_join(words, " ")

    def of(script: str, i: Column) -> Column:
        at = _draw(seed, i)
        given = F.when(female, _pick(NAMES[script, "female"], at)).otherwise(_pick(NAMES[script, "male"], at))
        return F.when((i == 0) & (F.size(words) > 1), given).otherwise(
            F.concat(_pick(NAMES[script, "family"], at), _syllables(script, seed, draw)))

    drawn = F.transform(words, lambda w, i: F.lower(
        F.when(rest.rlike(r"\p{IsCyrillic}"), of("cyrillic", i)).when(rest.rlike(r"\p{IsGreek}"), of("greek", i))
        .otherwise(of("latin", i))))
    return F.concat(title, F.lit(" "), F.array_join(drawn, " "))


def surrogate(kind: Column, canon: Column, draw: Column, key: str = KEY) -> Column:
    """Canonical form of the surrogate."""
    inner = F.sha2(F.concat_ws("|", F.lit(key), kind, draw.cast("string"), canon), 256)
    entity = F.struct(kind.alias("kind"), canon.alias("canon"), draw.alias("draw"),
                      F.sha2(F.concat(F.lit(key), inner), 256).alias("seed"))

    def drawn(e):
        kind, canon, draw, seed = e["kind"], e["canon"], e["draw"], e["seed"]
        octets = [F.pmod(_draw(seed, F.lit(i)), F.lit(254)) + 1 for i in range(4)]
        return (
            F.when(kind == "email", _email(canon, seed, draw))
            .when(kind == "card", _card(canon, seed))
            .when(kind == "ip", F.concat_ws(".", *[o.cast("string") for o in octets]))
            .when(kind == "name", _name(canon, seed, draw))
            .when(kind.isin("assigned", "secret"), _recode(_longer(canon, draw), seed))
            .otherwise(_recode(canon, seed)))

    return _bound(entity, drawn)


def _cased(like: Column, text: Column) -> Column:
    return F.when((F.upper(like) == like) & (F.lower(like) != like), F.upper(text)).otherwise(text)


def rendered(kind: Column, value: Column, drawn: Column) -> Column:
    """The surrogate ``drawn`` written in the format of ``value``."""
    chars = F.split(value, "")
    # numbers: the n-th digit takes the n-th drawn digit, whatever stands between, so that what is written is what was
    # checked for collisions; digits before them are a country code and stay
    code = F.greatest(F.char_length(F.regexp_replace(value, r"\D", "")) - F.char_length(drawn), F.lit(0))
    digits = F.aggregate(
        chars, F.struct(F.lit("").alias("out"), (F.lit(1) - code).alias("k")),
        lambda s, c: F.when(c.rlike("[0-9]"), F.struct(
            F.concat(s["out"], F.when(s["k"] < 1, c).otherwise(F.substring(drawn, s["k"], F.lit(1)))).alias("out"),
            (s["k"] + 1).alias("k")))
        .otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k"))), lambda s: s["out"])
    by_letter = F.array_join(F.transform(F.split(drawn, ""), lambda c, i: F.when(
        (F.upper(F.get(chars, i)) == F.get(chars, i)) & (F.lower(F.get(chars, i)) != F.get(chars, i)),
        F.upper(c)).otherwise(c)), "")
    quote = F.char_length(F.regexp_extract(value, r"^(.*?[\"'])", 1))
    inside = F.substring(value, quote + 1, F.char_length(value) - quote - 1)
    assigned = F.concat(F.substring(value, F.lit(1), quote), _cased(inside, drawn),
                        F.substring(value, F.char_length(value), F.lit(1)))
    title = F.regexp_extract(value, r"^(\S+\s+)", 1)
    named = F.concat(title, _cased(F.regexp_replace(value, r"^\S+\s+", ""), F.initcap(
        F.regexp_replace(drawn, r"^\S+\s", ""))))
    return (
        F.when(kind.isin("card", "ssn", "phone"), digits).when(kind == "assigned", assigned)
        .when(kind == "name", named).when(kind == "ip", drawn).otherwise(by_letter))


def _values(text: Column) -> Column:
    """All mentions in order; null where there can be none."""
    return F.when(text.rlike(MAYBE), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct entities of the corpus: kind, canon."""
    return _entities(docs.select(_values(F.col(text_col)).alias("values")))


def _entities(found: DataFrame) -> DataFrame:
    values = found.select(F.explode("values").alias("value")).distinct().withColumn("kind", entity_type(F.col("value")))
    return values.select("kind", canonical(F.col("kind"), F.col("value")).alias("canon")).distinct()


def draw_surrogates(found: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, canon, draw int, drawn): distinct surrogates, none of which is an entity of the corpus.

    Raises ValueError where that cannot be: only numbers have a fixed length, so only they can run out of surrogates.
    """
    def with_draw(rows):
        return rows.withColumn("drawn", surrogate(F.col("kind"), F.col("canon"), F.col("draw"), key))

    current = stored(with_draw(found.withColumn("draw", F.lit(0))), "surrogates")
    left, idle = None, 0
    while True:
        shared = current.groupBy("kind", "drawn").agg(F.min("canon").alias("first"), F.count("*").alias("n")).filter(
            "n > 1")
        second = current.join(shared.select("kind", "drawn", "first"), ["kind", "drawn"]).filter(
            "canon != first").select("kind", "canon")
        real = current.join(found.select("kind", F.col("canon").alias("drawn")), ["kind", "drawn"], "left_semi").select(
            "kind", "canon")
        clash = stored(second.union(real).distinct(), "surrogate-clashes")
        before, left = left, clash.count()
        if left == 0:
            return current
        idle = idle + 1 if before is not None and left >= before else 0
        if idle == IDLE_DRAWS:
            kinds = sorted(r.kind for r in clash.select("kind").distinct().collect())
            raise ValueError(f"{left} entities of {', '.join(kinds)} have no free surrogate")
        again = with_draw(current.join(clash, ["kind", "canon"], "left_semi").select(
            "kind", "canon", (F.col("draw") + 1).alias("draw")))
        current = stored(current.join(clash, ["kind", "canon"], "left_anti").unionByName(again), "surrogates")


def pseudonymise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY) -> DataFrame:
    """All columns of ``docs`` as struct ``record``, with the rewritten ``text`` and ``n_entities`` (int).

    Null texts stay null. Rows that repeat an id, and rows with a null id, are rewritten each by itself.
    """
    rows = docs.select(F.struct("*").alias("record"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # texts are searched once; what was found is kept beside them
    found = stored(rows.withColumn("values", _values(F.col("text"))), "mentions")
    drawn = draw_surrogates(_entities(found), key)
    redrawn = drawn.filter("draw > 0")
    none = F.lit(None).cast("map<string,int>")
    if redrawn.isEmpty():
        looked_up = found.withColumn("draws", none)
    else:
        mentions = found.select("id", F.explode("values").alias("value")).withColumn(
            "kind", entity_type(F.col("value")))
        mentions = mentions.select("id", "kind", canonical(F.col("kind"), F.col("value")).alias("canon")).distinct()
        hits = mentions.join(redrawn, ["kind", "canon"]).groupBy("id").agg(F.map_from_entries(F.collect_set(
            F.struct(F.concat_ws(":", "kind", "canon"), "draw"))).alias("draws"))
        hits = hits.withColumnRenamed("id", "hit_id")
        looked_up = found.join(hits, F.col("id").eqNullSafe(F.col("hit_id")), "left")

    def replaced(value):
        # types, canonical forms and surrogates are computed once per mention and carried along
        known = F.transform(F.array(value), lambda v: F.struct(v.alias("v"), entity_type(v).alias("k")))
        known = F.transform(known, lambda e: F.struct(e["v"].alias("v"), e["k"].alias("k"),
                                                      canonical(e["k"], e["v"]).alias("c")))
        known = F.transform(known, lambda e: F.struct(e["v"].alias("v"), e["k"].alias("k"), surrogate(
            e["k"], e["c"], F.coalesce(F.element_at("draws", F.concat_ws(":", e["k"], e["c"])), F.lit(0)), key).alias(
            "d")))
        return F.element_at(F.transform(known, lambda e: rendered(e["k"], e["v"], e["d"])), 1)

    any_found = F.size("values") > 0
    made = looked_up.withColumn("made", F.when(any_found, F.transform("values", replaced)))
    pieces = F.split(F.col("text"), ANY, -1)
    rewritten = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get("made", i), F.lit("")))), "")
    return made.select(
        "record", F.when(any_found, rewritten).otherwise(F.col("text")).alias("text"),
        F.coalesce(F.when(any_found, F.size("values")), F.lit(0)).alias("n_entities"))
