"""Personal data replaced by surrogates: keyed, of the same type, gender, script and format.

An entity is its canonical form (an address in lower case, a number's digits), so all
mentions anywhere get the same surrogate, each laid out as that mention was. A surrogate
follows from a key, the entity, an attempt number, and a name's gender. All different
entities of a corpus are held against each other: where two would share a surrogate, or
one would turn into what another really is, the one of the larger hash takes its next
attempt. Every ``GROWS`` attempts a surrogate gets longer, so all become different in the
end. A name has one gender in the whole corpus: the one that all titles before it agree
on, else none, so it is the same person's name after every title.

The key is a secret of whoever runs this: with it, surrogates can be traced back.
"""

from __future__ import annotations

import hmac
import itertools
import re
import secrets
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from .common import batch, free, pieces, shared_dir, texts, with_texts, work, written

KEY_SETTING = "spark.lazyframe.surrogates.key"
#: Titles before names by gender.
TITLES = {"f": ("Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Sra", "Señora", "г-жа"), "m": ("Mr", "Herr", "Monsieur", "Sr", "Señor", "г-н"), "n": ("Dr", "Prof")}
_GENDER = {t: g for g, all_ in TITLES.items() for t in all_}
_NAME = r"[^\W\d_a-zß-öø-ÿа-яα-ω][^\W\d_]+(?:-[^\W\d_]+)?"
NAMED = re.compile(rf"\b({'|'.join(sorted(_GENDER, key=len, reverse=True))})\.?[ \xa0]({_NAME}(?:[ \xa0]{_NAME}){{0,2}})")
PATTERN = re.compile(
    r"(?P<email>[A-Za-z0-9][\w.+%-]{0,63}@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,})"
    r"|(?P<secret>(?i:\b(?:password|passwd|pwd|secret|token|api_?key)\s*[=:]\s*[\"']?)(?P<value>[^\s\"',;]{6,}))"
    r"|(?P<key>\b(?:AKIA|ASIA)[A-Z0-9]{16}\b)"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]))"
)
HINT = re.compile(r"[0-9@=:]")


def session_key(spark: SparkSession) -> bytes:
    """The key that the session's setting ``KEY_SETTING`` names. Where there is none, a random one, kept in
    the shared folder for its owner's eyes, so that all queries with this folder agree."""
    own = spark.conf.get(KEY_SETTING, None)
    if own:
        return own.encode()
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/surrogates.key")
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(at):
        out = store.create(at, False)
        out.writeBytes(secrets.token_hex(32))
        out.close()
        store.setPermission(at, spark._jvm.org.apache.hadoop.fs.permission.FsPermission("600"))
    with_ = store.open(at)
    try:
        return bytes(with_.readAllBytes())
    finally:
        with_.close()


class Mention:
    """``gender`` (f, m or n) is what the text says of a name; it is no part of the entity."""

    __slots__ = ("start", "end", "kind", "entity", "gender")

    def __init__(self, start: int, end: int, kind: str, entity: str, gender: str = "n"):
        self.start, self.end, self.kind, self.entity, self.gender = start, end, kind, entity, gender


def _low(text: str) -> str:
    """In lower case letter by letter; a letter whose lower case is longer stays."""
    return "".join([low if len(low := c.lower()) == 1 else c for c in text])


def mentions(text: str) -> list[Mention]:
    """What is to be replaced, in order and without overlap. Names count where a title stands before them,
    and then wherever else in the text the same capitalised word stands."""
    out = []
    if HINT.search(text):
        for m in PATTERN.finditer(text):
            kind = m.lastgroup if m.lastgroup != "value" else "secret"
            kind = "secret" if m["secret"] else kind
            start, end = m.span("value") if kind == "secret" else m.span()
            whole = text[start:end]
            if kind in ("phone", "card", "ssn"):
                entity = re.sub(r"\D", "", whole)
                if kind == "card" and _luhn(entity):  # some other long number
                    continue
            elif kind == "iban":
                entity = whole.replace(" ", "")
            else:
                entity = _low(whole) if kind == "email" else whole
            out.append(Mention(start, end, kind, entity))
    genders: dict[str, str] = {}
    for m in NAMED.finditer(text):
        for word in re.split(r"[ \xa0]", m[2]):
            genders[word] = _GENDER[m[1]] if genders.get(word, "n") == "n" else genders[word]
    if genders:
        taken = [(x.start, x.end) for x in out]
        for m in re.finditer(rf"\b(?:{'|'.join(map(re.escape, sorted(genders, key=len, reverse=True)))})\b", text):
            if not any(a < m.end() and m.start() < b for a, b in taken):
                out.append(Mention(m.start(), m.end(), "name", m[0], genders[m[0]]))
    return sorted(out, key=lambda x: x.start)


class _Stream:
    """Numbers that follow from key, entity and attempt."""

    def __init__(self, key: bytes, kind: str, entity: str, attempt: int):
        self.key, self.seed, self.n, self.left = key, f"{kind}\0{entity}\0{attempt}".encode(), 0, b""

    def below(self, most: int) -> int:
        if len(self.left) < 4:
            self.left = hmac.digest(self.key, self.seed + b"\0%d" % self.n, "sha256")
            self.n += 1
        got, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return got % most

    def of(self, letters: str) -> str:
        return letters[self.below(len(letters))]


LATIN = "abcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789"
#: What a secret without a letter or digit is made of anew.
SYMBOLS = "!#$%&()*+-./:<=>?@[]^_{|}~"
#: So many attempts keep an entity's own length; after each so many more a surrogate has one character, syllable or number more.
GROWS = 4
#: By the first word of a letter's Unicode name.
SCRIPTS = {"LATIN": ("aeiou", "bdfghklmnprstvz"), "CYRILLIC": ("аеиоу", "бвгдзклмнпрст"), "GREEK": ("αειου", "βγδζκλμνπρστ")}


def _name(word: str, gender: str, s: _Stream, more: int = 0) -> str:
    """Open syllables of the word's script, ``more`` beyond its own, with an ending of its gender, in its case."""
    script = next((k for c in word if c.isalpha() and (k := unicodedata.name(c, "LATIN").split(" ")[0]) in SCRIPTS), "LATIN")
    vowels, others = SCRIPTS[script]
    made = "".join(s.of(others) + s.of(vowels) for _ in range(max(2, min(5, len(word) // 2)) + more)) + s.of(others)
    made += {"f": vowels[0], "m": "", "n": ""}[gender]
    return made.upper() if word.isupper() and len(word) > 1 else made.capitalize()


def _luhn(digits: str) -> int:
    """0 for a number with the right check digit at its end."""
    return sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10


def _iban_check(country: str, rest: str) -> str:
    """The two check digits that make the remainder by 97 one."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country) + '00') % 97:02d}"


def surrogate(kind: str, entity: str, key: bytes, attempt: int = 0, gender: str = "n") -> str:
    """The canonical form of the entity's surrogate; of the entity's length but for names and late attempts.

    An address of an early attempt has the entity's lengths, a late one any numbers, and one
    that even these don't tell apart gets further numbers."""
    s = _Stream(key, kind, entity, attempt)
    more = attempt // GROWS
    if kind == "name":
        return _name(entity, gender, s, more)
    if kind == "ip":
        low = {1: (1, 9), 2: (10, 90), 3: (100, 156)}
        if more:
            return ".".join(str(1 + s.below(254)) for _ in range(3 + more))
        return ".".join(str(low[len(x)][0] + s.below(low[len(x)][1])) for x in entity.split("."))
    keep = 0
    if kind == "key":
        keep = 4
    elif kind == "iban":
        keep = 2
    tail = entity.rindex(".") if kind == "email" else len(entity)
    out = list(entity)
    hexa = kind == "secret" and re.fullmatch(r"[0-9a-f]+", entity)
    bare = kind == "secret" and not any(c.isdigit() or c.isalpha() for c in entity)
    for k in range(keep, tail):
        c = entity[k]
        if hexa:
            out[k] = s.of("0123456789abcdef")
        elif bare:
            out[k] = s.of(SYMBOLS)
        elif c.isdigit():
            out[k] = s.of("123456789" if k == 0 or kind in ("phone", "ssn") else "0123456789")
        elif c.isalpha():
            new = s.of(LATIN)
            out[k] = new.upper() if c.isupper() else new
    letters = {"email": LATIN, "secret": SYMBOLS if bare else "0123456789abcdef" if hexa else LATIN}.get(kind, DIGITS)
    longer = [s.of(letters) for _ in range(more)]
    if kind == "card":
        out[-1:-1] = longer  # the check digit stays last
    elif kind == "email":
        out[:0] = longer
    else:
        out += longer
    if kind == "card":
        out[0] = entity[0]
        if _luhn(entity) == 0:
            out[-1] = str(-_luhn("".join(out[:-1]) + "0") % 10)
    if kind == "iban" and _iban_check(entity[:2], entity[4:]) == entity[2:4]:
        out[2:4] = _iban_check(entity[:2], "".join(out[4:]))
    return "".join(out)


def laid_out(mention: str, kind: str, made: str) -> str:
    """The surrogate in the mention's own format: its separators, or its case. What a longer one has beyond
    the mention follows it, or goes before an address."""
    if kind in ("phone", "card", "ssn"):
        digits = iter(made)
        return "".join([next(digits) if c.isdigit() else c for c in mention] + list(digits))
    if kind == "iban":
        rest = iter(made)
        return "".join([c if c == " " else next(rest) for c in mention] + list(rest))
    if kind == "email":
        longer = len(made) - len(mention)
        return made[:longer] + "".join(a.upper() if b.isupper() else a for a, b in zip(made[longer:], mention, strict=True))
    return made


def replaced(text: str, told: dict[tuple[str, str], tuple[int, str]], key: bytes) -> tuple[str, int]:
    """(the text with surrogates, mentions replaced). ``told``: attempt and gender of entities other than attempt 0 and the text's own gender."""
    found = mentions(text)
    if not found:
        return text, 0
    out, at = [], 0
    for m in found:
        if m.start < at:
            continue
        attempt, gender = told.get((m.kind, m.entity), (0, m.gender))
        out += [text[at : m.start], laid_out(text[m.start : m.end], m.kind, surrogate(m.kind, m.entity, key, attempt, gender))]
        at = m.end
    return "".join([*out, text[at:]]), len(found)


@work("surrogates")
def _entities(batches):
    schema = pa.schema([("kind", pa.string()), ("entity", pa.string()), ("gender", pa.string())])
    for x in pieces(batches, 1000):
        found = sorted({(m.kind, m.entity, m.gender) for t in texts(x.column(0)) for m in mentions(t)})
        if found:
            yield batch(schema, *zip(*found, strict=True))


def collisions(docs: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, attempt, gender) of the entities whose first surrogate won't do, and of names on whose gender
    texts differ; usually few.

    Works on the table of different entities, combined before each shuffle, so a mention
    that a third of all texts hold is one row. Surrogates of a kind are held against each
    other and against the real entities of that kind. Rounds go on until all differ: as
    surrogates grow with the attempt, there are soon far more than entities.
    """

    @work("surrogates")
    def made(batches):
        schema = pa.schema([("kind", pa.string()), ("entity", pa.string()), ("gender", pa.string()), ("mixed", pa.bool_()), ("attempt", pa.int32()), ("made", pa.string())])
        for x in pieces(batches, 5000):
            kinds, names, genders, _, attempts = (x.column(k).to_pylist() for k in range(5))
            yield batch(schema, *(x.column(k) for k in range(5)), [surrogate(k, e, key, a, g) for k, e, g, a in zip(kinds, names, genders, attempts, strict=True)])

    form = "kind string, entity string, gender string, mixed boolean, attempt int, made string"
    found = docs.select(F.col("text").cast("string").alias("text")).where("text is not null").mapInArrow(_entities, "kind string, entity string, gender string")
    one = lambda g: F.max((F.col("gender") == g).cast("int"))
    gender = F.when((F.col("m") == 1) & (F.col("f") == 0), "m").when((F.col("f") == 1) & (F.col("m") == 0), "f").otherwise("n")
    distinct = found.groupBy("kind", "entity").agg(one("m").alias("m"), one("f").alias("f"), one("n").alias("n"))
    distinct = distinct.select("kind", "entity", gender.alias("gender"), (F.col("m") + F.col("f") + F.col("n") > 1).alias("mixed"), F.lit(0).alias("attempt"))
    now = written(distinct.mapInArrow(made, form), "entities")
    real = now.select("kind", F.col("entity").alias("made"))
    for _ in itertools.count():
        # settled ones go first, then the smaller hash, so that only newcomers give way
        order = W.partitionBy("kind", "made").orderBy("attempt", F.xxhash64("kind", "entity"), "kind", "entity")
        ranked = now.withColumn("rank", F.row_number().over(order)).join(real.withColumn("is_real", F.lit(True)), ["kind", "made"], "left")
        bad = written(ranked.where("rank > 1 or is_real").select("kind", "entity", "gender", "mixed", (F.col("attempt") + 1).alias("attempt")), "retries")
        if bad.isEmpty():
            return now.where("attempt > 0 or mixed").select("kind", "entity", "attempt", "gender")
        kept = now.join(bad.select("kind", "entity"), ["kind", "entity"], "left_anti").select(*now.columns)
        now = written(kept.union(bad.mapInArrow(made, form)), "entities")


MOST_BROADCAST = 100_000


def with_surrogates(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with the texts replaced, all columns kept, and n_entities; n_chars follows where there is one.

    Two passes over the texts and no exchange of them. The later attempts that collisions
    force, and genders that texts differ on, go to the tasks as a table if there are at most
    ``MOST_BROADCAST``, a checked bound; beyond it they are joined to the different texts that
    mention them. Null texts stay null with 0 entities; repeated rows and null ids change
    nothing; clashing ``n_entities`` of ``docs`` is replaced; an empty table gives none.
    """
    later = collisions(docs, key)
    few = later.limit(MOST_BROADCAST + 1).collect()
    docs = docs.select(*[c for c in docs.columns if c != "n_entities"])
    names = docs.columns
    schema = StructType([f if f.name not in ("text", "n_chars") else StructField(f.name, StringType() if f.name == "text" else LongType()) for f in docs.schema.fields] + [StructField("n_entities", IntegerType())])
    d, at, width = with_texts(docs)
    told = None
    if len(few) <= MOST_BROADCAST:
        told = {(r[0], r[1]): (r[2], r[3]) for r in few}
    else:
        d = _with_later(d, at, later)

    @work("surrogates")
    def run(batches):
        for x in pieces(batches, 500):
            mine = [told] * x.num_rows if told is not None else [{(r["kind"], r["entity"]): (r["attempt"], r["gender"]) for r in a or ()} for a in x.column(x.num_columns - 1).to_pylist()]
            got = [(None, 0) if t is None else replaced(t, a, key) for t, a in zip(x.column(at).to_pylist(), mine, strict=True)]
            new = {"text": pa.array([g[0] for g in got], pa.string()), "n_chars": pa.array([None if g[0] is None else len(g[0]) for g in got], pa.int64())}
            yield pa.RecordBatch.from_arrays([*(new[c] if c in new else x.column(k) for k, c in enumerate(names[:width])), pa.array([g[1] for g in got], pa.int32())], names=[*names, "n_entities"])

    return d.mapInArrow(run, schema)


def _with_later(d: DataFrame, at: int, later: DataFrame) -> DataFrame:
    """``d`` with a last column of the rows of ``later`` that its text mentions; a text that very many rows hold is looked into once."""
    pair = pa.schema([("text", pa.string()), ("kind", pa.string()), ("entity", pa.string())])

    @work("surrogates")
    def pairs(batches):
        for x in pieces(batches, 1000):
            rows = sorted({(i, m.kind, m.entity) for i, t in zip(x.column(0).to_pylist(), texts(x.column(1)), strict=True) for m in mentions(t)})
            if rows:
                yield batch(pair, *zip(*rows, strict=True))

    name, found = free(d, "text_id", "later")
    d = d.withColumn(name, F.sha2(F.coalesce(F.col(d.columns[at]), F.lit("")), 256))
    mentioned = d.select(name, F.col(d.columns[at])).mapInArrow(pairs, "text string, kind string, entity string").distinct()
    told = mentioned.join(later, ["kind", "entity"]).groupBy(F.col("text").alias(name)).agg(F.collect_list(F.struct("kind", "entity", "attempt", "gender")).alias(found))
    return d.join(told, name, "left").drop(name)
