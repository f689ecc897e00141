"""Labelled findings to learn from where nobody judged any: texts with secrets of public formats, and with what is mistaken for them.

A finding's label is that of the kind it was made as; it doesn't follow from any feature that the forest reads. All is
made by DataFrame operations from a range of numbers and their hashes, so that a seed gives the same texts anywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FINDINGS, SEED = 12_000, 5
#: Every so manieth finding is held out from learning.
HELD_OUT = 4
# How secrets are written down, where they stand, and what looks like them.
ASSIGNED = ('token = "', 'secret: "', "api_key='", '"auth_token": "', "access_key => '", 'export API_KEY="', 'private_key = "', "credential: '")
BARE = ("token=", "DB_PASSWORD=", "api-key: ", "secret=", "client_secret: ", "ACCESS_KEY=")
PASSWORDS = ('password: "', "passwd = '", 'DB_PASSWORD="', '"user_password": "')
LOOSE = ("use ", "with ", "the key ", "login ", "")
DIGESTS = ("commit ", "sha256: ", 'md5 = "', 'checksum: "', '"etag": "', "revision ", "digest=", "hash ")
NUMBERS = ("card ", "number ", "order ", "isbn ", "phone ", "", "", "serial ")
SOURCE_PATHS = ("src/{}/config.py", "deploy/{}/values.yaml", "{}/.env", "app/{}.json", "src3", "")
TEST_PATHS = ("tests/{}/fixtures.py", "docs/{}.md", "examples/{}/app.py", "{}/mock/sample.json")
PLACEHOLDERS = ("your_api_key_here", "xxxxxxxxxxxxxxxx", "changeme", "<your-token>", "${API_KEY}", "example-token-1234", "0123456789abcdef0123456789abcdef", "placeholder123456", "REPLACE_ME_12345", "process.env.TOKEN", "abcdef0123456789", "1234567890123456")
PEM = ("-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----")


class _Made:
    """Columns of random parts for a row of `n`."""

    def __init__(self, words: list[str], seed: int):
        self.seed = seed
        self.vocabulary = F.array(*map(F.lit, words or ["word"]))
        self.size = len(words or ["word"])
        self.drawn = 0

    def draw(self, below: int) -> Column:
        self.drawn += 1
        return F.pmod(F.xxhash64(F.lit(self.seed), F.lit(self.drawn), "n"), F.lit(below)).cast("int")

    def one(self, values: tuple) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), self.draw(len(values)) + 1)

    def word(self) -> Column:
        return F.element_at(self.vocabulary, self.draw(self.size) + 1)

    def words(self, n: int) -> Column:
        return F.concat_ws(" ", *(self.word() for _ in range(n)))

    def hex(self) -> Column:
        """128 hex digits."""
        self.drawn += 2
        return F.concat(*(F.sha2(F.concat_ws("|", F.lit(self.seed), F.lit(self.drawn - k), "n"), 256) for k in range(2)))

    def base64(self, n: int) -> Column:
        return F.substring(F.regexp_replace(F.base64(F.unhex(self.hex())), "[\r\n=]", ""), 1, n)

    def letters(self, n: int) -> Column:
        """Up to n letters and digits."""
        return F.substring(F.regexp_replace(self.base64(84), "[+/]", ""), 1, n)

    def digits(self, n: int) -> Column:
        return F.substring(F.translate(self.hex(), "abcdef", "907153"), 1, n)

    def cut(self, value: Column, sizes: tuple[int, ...]) -> Column:
        return F.substr(value, F.lit(1), self.one(sizes))

    def path(self, paths: tuple[str, ...]) -> Column:
        return F.replace(self.one(paths), F.lit("{}"), self.word())


def _kinds(m: _Made) -> dict[str, tuple[int, Callable[[], tuple[Column, Column, tuple[str, ...]]]]]:
    """Each kind's label and how its lead, value and paths are made."""
    url = lambda c: F.translate(c, "+/", "-_")
    return {
        "hex key": (1, lambda: (m.one(ASSIGNED + BARE), m.cut(m.hex(), (32, 40, 64)), SOURCE_PATHS)),
        "letter key": (1, lambda: (m.one(ASSIGNED + BARE), m.cut(m.letters(48), (16, 20, 24, 32, 44)), SOURCE_PATHS)),
        "base64 key": (1, lambda: (m.one(ASSIGNED + BARE), F.concat(m.base64(43), F.lit("=")), SOURCE_PATHS)),
        "prefixed key": (1, lambda: (m.one(LOOSE + ASSIGNED + BARE), F.concat(m.one(("ghp_", "sk_live_", "xoxb-", "glpat-", "AIza", "npm_")), m.letters(36)), SOURCE_PATHS)),
        "account key": (1, lambda: (m.one(LOOSE + BARE), F.concat(F.lit("AKIA"), F.upper(m.letters(16))), SOURCE_PATHS)),
        "web token": (1, lambda: (m.one(("Authorization: Bearer ", "token=", 'jwt_token: "', "")), F.concat(F.lit("eyJhbGciOiJIUzI1NiJ9.eyJ"), url(m.base64(40)), F.lit("."), url(m.base64(43))), SOURCE_PATHS)),
        "password": (1, lambda: (m.one((*PASSWORDS, "DB_PASSWORD=", "password: ")), F.concat(F.initcap(F.substr(m.word(), F.lit(1), F.lit(6))), m.one(("&", "!", "#", "_", "$", "%")), m.digits(3), m.letters(3)), SOURCE_PATHS)),
        "passphrase": (1, lambda: (m.one(("passphrase: \"", *PASSWORDS)), m.words(5), SOURCE_PATHS)),
        "key block": (1, lambda: (m.one(LOOSE), F.concat(F.lit(PEM[0] + "\n"), m.base64(64), F.lit("\n"), m.base64(64), F.lit("==\n" + PEM[1])), SOURCE_PATHS)),
        "placeholder": (0, lambda: (m.one(ASSIGNED + BARE + PASSWORDS), m.one(PLACEHOLDERS), SOURCE_PATHS + TEST_PATHS)),
        "test key": (0, lambda: (m.one(ASSIGNED + BARE), m.cut(m.hex(), (32, 40, 64)), TEST_PATHS)),
        "digest": (0, lambda: (m.one(DIGESTS), m.cut(m.hex(), (32, 40, 64)), SOURCE_PATHS + TEST_PATHS)),
        "uuid": (0, lambda: (m.one(("id: ", 'uuid = "', "request ", "")), F.regexp_replace(F.substring(m.hex(), 1, 32), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), SOURCE_PATHS + TEST_PATHS)),
        "number": (0, lambda: (m.one(NUMBERS), m.cut(m.digits(20), (12, 13, 16, 19)), SOURCE_PATHS + TEST_PATHS)),
        "time": (0, lambda: (m.one(("at ", "since ", "")), F.concat(F.lit("20"), m.digits(2), F.lit("-11-"), m.digits(2), F.lit("T15-"), m.digits(2)), SOURCE_PATHS + TEST_PATHS)),
        "file": (0, lambda: (m.one(("see ", "open ", "")), F.concat(m.word(), F.lit("/"), m.word(), F.lit("_"), m.word(), m.digits(2)), SOURCE_PATHS + TEST_PATHS)),
        "name": (0, lambda: (m.one(("call ", "the ", "token=", "secret: ", "")), F.concat(m.word(), F.lit("_"), m.word(), F.lit("-"), m.word(), F.lit("_"), m.digits(1)), SOURCE_PATHS + TEST_PATHS)),
        "sentence": (0, lambda: (m.one(("the secret: ", "token: ", "private: ", "authors: ", "auth: ")), m.word(), SOURCE_PATHS + TEST_PATHS)),
        "picture": (0, lambda: (m.one(("data:image/png;base64,", "url(data:font/woff2;base64,")), F.concat(m.base64(80), F.lit("=")), SOURCE_PATHS + TEST_PATHS)),
    }


def findings(spark: SparkSession, words: list[str], n: int = FINDINGS, seed: int = SEED) -> DataFrame:
    """(id, path, text, start, length, label, kind, held_out): n texts of words with one finding each, evenly of all kinds.

    words: what texts, names and sentences are made of, such as the most frequent words of the texts to be scanned.
    """
    made = _Made(words, seed)
    rows = spark.range(n).withColumnRenamed("id", "n")
    kinds = _kinds(made)
    labels = [label for label, _ in kinds.values()]
    # Even numbers make secrets, odd ones what isn't one.
    sides = {label: [k for k, x in enumerate(labels) if x == label] for label in (0, 1)}
    turn = F.expr("n div 2")
    kind = F.when(F.col("n") % 2 == 0, F.element_at(F.array(*map(F.lit, sides[1])), (turn % len(sides[1]) + 1).cast("int"))).otherwise(F.element_at(F.array(*map(F.lit, sides[0])), (turn % len(sides[0]) + 1).cast("int")))
    rows = rows.withColumn("kind", kind)
    part = None
    for k, (_, make) in enumerate(kinds.values()):
        lead, value, paths = make()
        fields = F.struct(lead.alias("lead"), value.alias("value"), made.path(paths).alias("path"))
        part = F.when(F.col("kind") == k, fields) if part is None else part.when(F.col("kind") == k, fields)
    rows = rows.withColumn("x", part).select("n", "kind", "x.*", made.words(7).alias("first"), made.words(6).alias("last"))
    head = F.concat("first", F.lit(" "), "lead")
    quote = F.when(F.col("lead").rlike("[\"']$"), F.substring("lead", -1, 1)).otherwise(F.lit(""))
    names, label = (F.element_at(F.array(*map(F.lit, x)), F.col("kind") + 1) for x in (list(kinds), labels))
    return rows.select(
        F.col("n").alias("id"), "path", F.concat(head, "value", quote, F.lit(" "), "last").alias("text"), F.length(head).cast("long").alias("start"), F.length("value").cast("long").alias("length"),
        label.cast("double").alias("label"), names.alias("kind"), (F.pmod(F.xxhash64(F.lit("held out"), "n"), F.lit(HELD_OUT)) == 0).alias("held_out"),
    )
