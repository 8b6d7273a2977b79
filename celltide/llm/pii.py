"""Surrogates for personal data, in DataFrame operations only.

Entities are found by pattern, written in a canonical form (so one entity in several
spellings stays one entity), and every distinct entity of the corpus receives one keyed
surrogate of its type. Surrogates keep type, script and format: digits stay digits, letters
stay letters of their case, card numbers that satisfy the Luhn check still do, addresses keep
their shape, names keep honorific, gender and script (Latin, Greek, Cyrillic, Han; letters of any other
script become Latin ones, never themselves). Later mentions of a found name in the same text, with or
without honorific, get the same surrogate. A surrogate that another entity already
has, or that is itself an entity of the corpus, is drawn again with the next attempt number
until all are distinct; so distinct entities stay distinct and equal ones stay equal in all
documents, whichever executor handles them.

Surrogates come from HMAC-SHA-512 under a key that the caller gives: without it neither a surrogate
can be computed for a guessed entity, nor the other way round.

Types: email, card (13 to 19 digits), phone, ssn, ip, aws (access key ids), hex and secret
(keys and passwords after = or :, long hexadecimal strings), given names (m, f, x where the honorific
tells no gender) and surnames after an honorific; a name that never stands after one is not found.

Defined results: null and empty texts stay as they are, with no entities; overlapping
patterns go to the first in the order above; equal texts get equal results; an empty table
gives an empty table; very long texts are searched whole; ties of candidate surrogates go to the smaller
attempt, then the smaller entity; all other columns pass through. Entities whose type's space is used up
after `ATTEMPTS` rounds become a distinct bracketed tag.

Scale: texts without an entity are never shuffled, and most are told by two cheap patterns. The
others are written to the shared folder once and meet their surrogates through the digest of
the text, once for all copies of it; entities are made distinct before anything is joined; the
collision rounds touch the table of distinct entities only, and each is written too.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from celltide.llm.common import fresh, written

ATTEMPTS = 24

MALE = "Mr|Κος|Sir|Herr|Señor|Monsieur|Signor|г-н|господин"
NEUTRAL = "Dr|Prof|Professor|Doctor|Mx|Д-р|Δρ"
FEMALE = "Mrs|Κα|Ms|Miss|Madam|Frau|Señora|Señorita|Madame|Mme|Signora|г-жа|госпожа"
_NAME = r"(?:\p{Lu}[\p{L}'’-]+|\p{IsHan}{2,4})"

PATTERNS = {
    "email": r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++@[\p{L}0-9-]++(?:\.[\p{L}0-9-]++)+",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"
    r"|(?<![0-9])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])"
    r"|(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9\p{L}])(?:[0-9]{4}[ -]){3}[0-9]{1,7}(?![0-9\p{L}])|(?<![0-9\p{L}])[0-9]{13,19}(?![0-9\p{L}])",
    "aws": r"(?<![A-Z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Z0-9])",
    "hex": r"(?<![0-9A-Za-z])(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{16,}(?![0-9A-Za-z])",
    "secret": r"(?<=[=:] ?[\"']?)[A-Za-z0-9_+/-]{12,}={0,2}(?![A-Za-z0-9])",
    "name": rf"(?<![\p{{L}}])(?:{MALE}|{FEMALE}|{NEUTRAL})\.? {_NAME}(?: {_NAME})?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# Every match holds one of these characters or follows one, or begins with one of these words.
SIGNS = "[0-9@=:]"
WORDS = f"(?=[MSHFADPгДΔΚ])(?:{MALE}|{FEMALE}|{NEUTRAL}|AKIA|ASIA)"

# Syllables of made-up names, by script.
_SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ja jo ka ke la le lo ma me mi na ne no pa pe ra re ro sa se ta te to va ve wa".split(),
    "greek": "βα βε γα γε δα δε ζα θα θε κα κε λα λε λο μα με μι να νε νο πα πε ρα ρε σα σε τα τε φα χα".split(),
    "han": list("伟芳娜敏静丽强磊军洋勇艳杰娟涛明超兰霞平刚桂英华文玉建国海燕"),
    "cyrillic": "ба бе бо ва ве го да де до жа за зо ка ке ла ле ло ма ме ми на не но па пе ра ре ро са се та те то фа ха ша".split(),
}
_ENDINGS = {
    ("latin", "m"): ["n", "rt", "s", "ld"],
    ("latin", "f"): ["na", "la", "ra", "ia"],
    ("latin", "s"): ["son", "berg", "ner", "ton", "well", "mann"],
    ("greek", "m"): ["νος", "ρης", "λος", "κης"],
    ("greek", "f"): ["να", "ρα", "λη", "νη"],
    ("greek", "s"): ["πουλος", "ιδης", "ακης", "ου"],
    ("han", "m"): list("刚强军峰"),
    ("han", "f"): list("娜芳丽兰"),
    ("han", "s"): list("氏家林田"),
    ("cyrillic", "m"): ["н", "р", "с", "т"],
    ("cyrillic", "f"): ["на", "ра", "ия", "ла"],
    ("cyrillic", "s"): ["ко", "ич", "дзе", "ян"],
}
for _script in _SYLLABLES:
    _ENDINGS[_script, "x"] = _ENDINGS[_script, "m"] + _ENDINGS[_script, "f"]
_SCRIPTS = {"cyrillic": "[Ѐ-ӿ]", "greek": "[Ͱ-Ͽἀ-῿]", "han": "\\p{IsHan}"}


def _sql_list(values: list[str]) -> str:
    return "array(" + ", ".join("'" + v.replace("'", "\\'") + "'" for v in values) + ")"


def _rlike(value: str, pattern: str) -> str:
    return f"{value} rlike r'{pattern}'"


def kind_of(value: Column) -> Column:
    """The type of a match: the first pattern that matches all of it."""
    out = F.lit("name")
    whole = [(k, p.replace("(?<=[=:] ?[\"']?)", "")) for k, p in PATTERNS.items() if k != "name"]
    for kind, pattern in reversed(whole):
        out = F.when(value.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def parts_of(value: Column) -> Column:
    """(kind, canonical form, word of a name) of each part of a match; names have one or two parts."""
    kind = kind_of(value)
    digits = F.regexp_replace(value, "[^0-9]", "")
    canon = (
        F.when(kind.isin("card", "ssn"), digits)
        .when(kind == "phone", F.concat(F.when(value.startswith("+"), "+").otherwise(""), digits))
        .when(kind.isin("email", "hex"), F.lower(value))
        .otherwise(value)
    )
    words = F.slice(F.split(value, " "), 2, 2)
    given = F.when(value.rlike(f"^(?:{MALE})\\.? "), "given_m").when(value.rlike(f"^(?:{FEMALE})\\.? "), "given_f").otherwise("given_x")
    named = F.transform(
        words, lambda w, i: F.struct(F.when((i == 0) & (F.size(words) == 2), given).otherwise("surname").alias("kind"), F.lower(w).alias("canon"), w.alias("word"))
    )
    one = F.array(F.struct(kind.alias("kind"), canon.alias("canon"), F.lit(None).cast("string").alias("word")))
    return F.when(kind == "name", named).otherwise(one)


def _hmac(key: str, message: str) -> str:
    """SQL for the hexadecimal HMAC-SHA-512 of a text under a key."""
    k = key.encode()
    k = (hashlib.sha512(k).digest() if len(k) > 128 else k).ljust(128, b"\0")
    inner, outer = (bytes(x ^ pad for x in k).hex() for pad in (0x36, 0x5C))
    return f"sha2(concat(X'{outer}', unhex(sha2(concat(X'{inner}', cast({message} as binary)), 512))), 512)"


def _bytes(key: str, seed: str, length: str) -> str:
    """SQL for hexadecimal digest text of at least `length` bytes."""
    one = _hmac(key, f"concat({seed}, '/', cast(b as string))")
    return f"concat_ws('', transform(sequence(0, cast({length} / 64 as int)), b -> {one}))"


def _byte(stream: str, i: str) -> str:
    return f"cast(conv(substr({stream}, 2 * ({i}) + 1, 2), 16, 10) as int)"


def _redrawn(value: str, stream: str, keep: str, letters: str) -> str:
    """SQL: every digit and letter of `value` from position `keep` on drawn again, all else kept."""
    r = _byte(stream, "i")
    return f"""concat_ws('', transform(filter(split({value}, ''), c -> c <> ''), (c, i) -> CASE
        WHEN i < {keep} THEN c
        WHEN {_rlike('c', '^[0-9]$')} THEN cast({r} % 10 as string)
        WHEN {_rlike('c', '^[a-z]$')} THEN substr('{letters}', {r} % {len(letters)} + 1, 1)
        WHEN {_rlike('c', '^[A-Z]$')} THEN substr('{letters.upper()}', {r} % {len(letters)} + 1, 1)
        WHEN {_rlike('c', _SCRIPTS['cyrillic'])} THEN substr('абвгдежзиклмнопрстуфхцчшэюя', {r} % 27 + 1, 1)
        WHEN {_rlike('c', _SCRIPTS['greek'])} THEN substr('αβγδεζηθικλμνξοπρστυφχψω', {r} % 24 + 1, 1)
        WHEN {_rlike('c', _SCRIPTS['han'])} THEN substr('{"".join(_SYLLABLES["han"])}', {r} % {len(_SYLLABLES["han"])} + 1, 1)
        WHEN {_rlike('c', chr(92) + 'p{L}')} THEN substr('{letters}', {r} % {len(letters)} + 1, 1)
        ELSE c END))"""


def _luhn_sum(digits: str) -> str:
    """SQL: the Luhn sum of a digit string, its last digit included."""
    d = "cast(c as int)"
    double = f"({d} * 2 - IF({d} > 4, 9, 0))"
    return f"""aggregate(transform(filter(split({digits}, ''), c -> c <> ''), (c, i) ->
        IF((length({digits}) - 1 - i) % 2 = 1, {double}, {d})), 0, (a, x) -> a + x)"""


def _candidate(key: str) -> str:
    """SQL over kind, canon and attempt: the surrogate's canonical form."""
    abc = "abcdefghijklmnopqrstuvwxyz"
    seed = "concat(kind, '|', cast(attempt as string), '|', canon)"
    x = "stream"
    card = _redrawn("canon", x, "1", abc)
    fix = f"concat(substr(drawn, 1, length(drawn) - 1), cast((10 - {_luhn_sum('concat(substr(drawn, 1, length(drawn) - 1), \'0\')')} % 10) % 10 as string))"
    card = f"transform(array({card}), drawn -> IF({_luhn_sum('canon')} % 10 = 0, {fix}, drawn))[0]"
    octets = f"concat_ws('.', transform(sequence(0, 3), k -> cast(1 + {_byte(x, 'k')} % 254 as string)))"
    top = "substring_index(canon, '.', -1)"
    email = _redrawn(f"left(canon, length(canon) - length({top}) - 1)", x, "0", abc)

    def name(part: str) -> str:
        cases = []
        for script in (*_SCRIPTS, "latin"):
            syllables, ends = _SYLLABLES[script], _ENDINGS[script, part]
            x_ = _sql_list(syllables)
            drawn = ", ".join(f"{x_}[{_byte(x, str(k))} % {len(syllables)}]" for k in range(3))
            made = f"concat({drawn}, {_sql_list(ends)}[{_byte(x, '3')} % {len(ends)}])"
            cases.append(f"WHEN {_rlike('canon', _SCRIPTS[script])} THEN {made}" if script in _SCRIPTS else f"ELSE {made}")
        return f"CASE {' '.join(cases)} END"

    made = f"""CASE kind
        WHEN 'email' THEN concat({email}, '.', {top})
        WHEN 'ip' THEN {octets}
        WHEN 'card' THEN {card}
        WHEN 'phone' THEN {_redrawn('canon', x, "IF(canon like '+%', 2, 0)", abc)}
        WHEN 'aws' THEN {_redrawn('canon', x, '4', abc)}
        WHEN 'hex' THEN {_redrawn('canon', x, '0', 'abcdef')}
        WHEN 'given_m' THEN {name('m')}
        WHEN 'given_f' THEN {name('f')}
        WHEN 'given_x' THEN {name('x')}
        WHEN 'surname' THEN {name('s')}
        ELSE {_redrawn('canon', x, '0', abc)} END"""
    return f"transform(array({_bytes(key, seed, 'length(canon)')}), stream -> {made})[0]"


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon, surrogate of distinct (kind, canon): all distinct within a kind and none an entity itself."""
    real = entities.select("kind", F.col("canon").alias("surrogate")).withColumn("real", F.lit(True))
    table = entities.select("kind", "canon", F.lit(0).alias("attempt"))
    for _ in range(ATTEMPTS):
        drawn = table.withColumn("surrogate", F.expr(_candidate(key)))
        same = W.partitionBy("kind", "surrogate").orderBy("attempt", "canon")
        drawn = drawn.withColumn("place", F.row_number().over(same)).join(real, ["kind", "surrogate"], "left")
        clash = (F.col("place") > 1) | F.col("real").isNotNull()
        drawn = written(drawn.select("kind", "canon", "surrogate", "attempt", clash.alias("clash")), "surrogates")
        if drawn.filter("clash").isEmpty():
            return drawn.select("kind", "canon", "surrogate")
        table = drawn.select("kind", "canon", (F.col("attempt") + F.col("clash").cast("int")).alias("attempt"))
    tag = F.concat(F.lit("["), "kind", F.lit("-"), F.substring(F.expr(_hmac(key, "concat(kind, canon)")), 1, 20), F.lit("]"))
    return drawn.select("kind", "canon", F.when(F.col("clash"), tag).otherwise(F.col("surrogate")).alias("surrogate"))


def _formatted(kind: Column, value: Column, s: Column) -> Column:
    """A surrogate's canonical form in the spelling of the match it replaces."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    new = F.regexp_replace(s, "[^0-9]", "")

    def put(c: Column, i: Column) -> Column:
        number = F.length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), "[^0-9]", ""))
        return F.when(c.rlike("^[0-9]$"), F.substring(new, number, F.lit(1))).otherwise(c)

    digits = F.array_join(F.transform(chars, put), "")
    upper = (value == F.upper(value)) & (value != F.lower(value))
    return (
        F.when(s.startswith("["), s)
        .when(kind.isin("card", "ssn", "phone"), digits)
        .when(kind.isin("email", "hex") & upper, F.upper(s))
        .otherwise(s)
    )


def _named(value: Column, surrogate_words: Column) -> Column:
    """A name match with its words replaced: the honorific stays, capitals as before."""
    head = F.substring_index(value, " ", 1)
    word = F.when(value == F.upper(value), F.upper(F.array_join(surrogate_words, " "))).otherwise(
        F.initcap(F.array_join(surrogate_words, " "))
    )
    return F.concat(head, F.lit(" "), word)


def key_of(spark: SparkSession) -> str:
    """The key of the registered queries: `spark.celltide.surrogate.key`, which real data need; else one for test tables."""
    return spark.conf.get("spark.celltide.surrogate.key", None) or "for test tables only"


def replace(docs: DataFrame, key: str, text: str = "text") -> tuple[DataFrame, str]:
    """`docs` with its entities replaced under a secret key, and a struct column (n_entities, kinds); returns it and the column's name.

    kinds: the number of entities by type, as an array of (kind, n) sorted by kind.
    """
    info = fresh(docs, "entities")
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("n", T.LongType())]))
    digest = fresh(docs, "digest")
    # two cheap patterns spare most texts the full one
    holds = (F.col(text).rlike(SIGNS) | F.col(text).rlike(WORDS)) & F.col(text).rlike(ANY)
    clean = docs.filter(~F.coalesce(holds, F.lit(False))).withColumn(
        info, F.struct(F.lit(0).cast("long").alias("n_entities"), F.array().cast(kind).alias("kinds"))
    )
    hit = written(docs.filter(holds).withColumn(digest, F.sha2(F.col(text), 256)), "entity-texts")
    found = (
        hit.select(F.col(digest).alias("digest"), F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0)).alias("matches"))
        .groupBy("digest")
        .agg(F.first("matches").alias("matches"))  # equal texts: equal matches
        .select("digest", F.posexplode("matches").alias("at", "value"))
        .select("digest", "at", "value", F.posexplode(parts_of(F.col("value"))).alias("part", "entity"))
        .select("digest", "at", "value", "part", "entity.kind", "entity.canon", "entity.word")
    )
    found = written(found, "entities")
    table = surrogates(found.select("kind", "canon").distinct(), key)
    mapped = found.join(table, ["kind", "canon"])
    made = F.when(
        F.col("kind").startswith("given") | (F.col("kind") == "surname"), F.col("surrogate")
    ).otherwise(_formatted(F.col("kind"), F.col("value"), F.col("surrogate")))
    steps = (
        mapped.select("digest", "at", "value", "part", "kind", "word", made.alias("new"))
        .groupBy("digest")
        .agg(F.array_sort(F.collect_list(F.struct("at", "part", "value", "kind", "word", "new"))).alias("steps"))
    )
    name_kinds = ("given_m", "given_f", "given_x", "surname")

    def at_match(i: Column) -> Column:
        own = F.filter(F.col("steps"), lambda s: s["at"] == i)
        return F.transform(
            F.array(F.struct(own.alias("own"))),
            lambda x: F.when(
                x["own"][0]["kind"].isin(*name_kinds),
                _named(x["own"][0]["value"], F.transform(x["own"], lambda s: s["new"])),
            ).otherwise(x["own"][0]["new"]),
        )[0]

    # matches with one part, the usual case, need no search
    count = F.col("steps")[F.size("steps") - 1]["at"] + 1
    plain = F.size("steps") == count
    simple = F.transform(
        F.col("steps"),
        lambda s: F.when(s["kind"].isin(*name_kinds), _named(s["value"], F.array(s["new"]))).otherwise(s["new"]),
    )
    news = F.when(plain, simple).otherwise(F.transform(F.sequence(F.lit(0), count - 1), at_match))
    kinds = F.transform(
        F.array_sort(F.array_distinct(F.transform("steps", lambda s: s["kind"]))),
        lambda k: F.struct(k.alias("kind"), F.size(F.filter("steps", lambda s: s["kind"] == k)).cast("long").alias("n")),
    )
    named = F.array_distinct(
        F.transform(F.filter("steps", lambda s: s["word"].isNotNull()), lambda s: F.struct(s["word"].alias("word"), F.initcap(s["new"]).alias("new")))
    )
    ready = steps.select("digest", news.alias("news"), named.alias("named"), count.cast("long").alias("n_entities"), kinds.alias("kinds"))
    ready = ready.select(*[F.col(c).alias(f"{info}_{c}") for c in ready.columns])
    joined = hit.join(ready, F.col(digest) == F.col(f"{info}_digest"))
    pieces = F.split(F.col(text), ANY, -1)
    woven = F.array_join(F.zip_with(pieces, F.col(f"{info}_news"), lambda p, n: F.concat(p, F.coalesce(n, F.lit("")))), "")
    # what is left of the names, wherever else they stand in the text
    woven = F.aggregate(
        F.col(f"{info}_named"),
        woven,
        lambda t, n: F.regexp_replace(t, F.concat(F.lit(r"(?<!\p{L})\Q"), n["word"], F.lit(r"\E(?!\p{L})")), n["new"]),
    )
    done = joined.select(
        *[woven.alias(c) if c == text else F.col(c) for c in docs.columns],
        F.struct(F.col(f"{info}_n_entities").alias("n_entities"), F.col(f"{info}_kinds").cast(kind).alias("kinds")).alias(info),
    )
    return clean.select(*docs.columns, info).unionByName(done), info
