import hashlib
import re

import pytest
from pyspark.sql import functions as F

from kilnframe.functions import diagnose, globs, hashing, labels, text

GLOBS = [
    # glob, path, label, path dialect, walk, deep
    ("src/**/*.go", "src/main.go", True, True, True, True),
    ("src/**/*.go", "src/a/b/main.go", True, True, True, True),
    ("src/*.go", "src/a/main.go", False, True, False, True),
    ("src/?.go", "src/a.go", True, True, True, True),
    ("src/?.go", "src/ab.go", False, False, False, False),
    ("a?b", "a/b", False, True, False, True),
    ("src/[a-c]*.go", "src/bat.go", True, True, True, True),
    ("src/[!a-c]*.go", "src/bat.go", False, False, False, False),
    ("src/[!a-c]*.go", "src/dog.go", True, True, True, True),
    ("**/x", "x", True, True, True, True),
    ("a/**", "a/b/c", True, True, True, True),
    ("a/**", "a", False, False, False, False),
    ("a.b+c", "a.b+c", True, True, True, True),
    ("a.b", "axb", False, False, False, False),
    ("*.{c,h}", "x.c", False, False, False, True),
    ("*.{c,h}", "x.{c,h}", True, True, True, False),
    ("x", "x\n", False, False, False, False),
    ("[]]", "]", True, True, True, True),
]


@pytest.mark.parametrize(("glob", "path", "label", "plain", "walk", "deep"), GLOBS)
def test_glob_dialects(glob, path, label, plain, walk, deep):
    got = [bool(re.compile(globs.to_regex(glob, d).replace(r"\z", r"\Z")).match(path)) for d in (globs.LABEL, globs.PATH, globs.WALK, globs.DEEP, globs.RAW)]
    assert got == [label, plain, walk, deep, plain]


def test_globs_in_spark_and_duckdb(spark):
    import duckdb

    df = spark.createDataFrame([(g, p) for g, p, *_ in GLOBS], "g string, p string")
    for dialect, k in ((globs.LABEL, 2), (globs.PATH, 3), (globs.DEEP, 5)):
        rows = df.withColumn("re", globs.regex_column(F.col("g"), dialect)).selectExpr("g", "p", "re", "p rlike re AS hit").collect()
        want = {(g[0], g[1]): g[k] for g in GLOBS}
        assert {(r["g"], r["p"]): r["hit"] for r in rows} == want
        for r in rows:
            assert duckdb.sql("SELECT regexp_matches(?, ?)", params=[r["p"], r["re"]]).fetchall() == [(want[r["g"], r["p"]],)]


@pytest.mark.parametrize("glob", ["a**", "**b/c", "a/***", "[a", "a[!"])
def test_invalid_globs(glob):
    with pytest.raises(globs.GlobError):
        globs.validate(glob)


def test_braces_need_leave():
    globs.validate("{a,b}", braces=True)
    with pytest.raises(globs.GlobError):
        globs.validate("{a,b}")
    with pytest.raises(globs.GlobError):
        globs.to_regex("{a", globs.DEEP)


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def test_prefixes(spark):
    lit = F.lit
    assert one(spark, *(globs.literal_prefix(lit(g)) for g in ("a/b/*.c", "*.c", "a/b/c.txt", "c.txt", "a/[x]/y"))) == ("a/b", "", "a/b", "", "a")
    assert one(spark, globs.ancestors(lit("a/b/c")))[0] == ["", "a", "a/b"]
    assert one(spark, globs.has_wildcards(lit("//...")), globs.has_wildcards(lit("//..."), dots=True), globs.has_wildcards(lit("a?"))) == (False, True, True)
    assert one(spark, labels.output_parent(lit("a/b/*.c")), labels.output_parent(lit("x"))) == ("a/b", None)


def test_labels(spark):
    lit = F.lit
    assert one(spark, labels.label(lit("a/b"), lit("c")), labels.package_of(lit("//a/b:c")), labels.name_of(lit("//a/b:c")), labels.package_of(lit("//a:b:c")), labels.package_of(lit("//a/b")), labels.name_of(lit("//a/b"))) == (
        "//a/b:c", "a/b", "c", "a:b", "a/b", "",
    )
    assert one(spark, *(labels.resolve_dep(lit("p"), lit(d)) for d in ("//x:y", ":z", "z"))) == ("//x:y", "//p:z", "//p:z")
    assert one(spark, *(labels.resolve_path(lit("p"), lit(x)) for x in ("//x", ".", "a")), labels.resolve_path(lit(""), lit("a")), labels.resolve_cwd(lit("p"), lit(None).cast("string"))) == ("x", "p", "p/a", "a", "p")
    assert one(spark, *(labels.is_subpackage(lit(a), lit(b)) for a, b in (("a/b", "a"), ("a", "a"), ("ab", "a"), ("a", ""), ("", "")))) == (True, False, False, True, False)
    assert one(spark, *(labels.normalize_package(lit(x), lit(y)) for x, y in (("//a/b/", "c"), (None, "./c/"), (None, None), (".", "x")))) == ("a/b", "c", "", "")
    assert one(spark, *(labels.is_config_filename(lit(n), "kiln") for n in ("kiln.yaml", "kiln.gen-1.json", "kiln.a.b.yml", "kiln.toml", "xkiln.yaml"))) == (True, True, False, False, False)
    assert one(spark, *(labels.is_relative_path(lit(p)) for p in ("a/b", "/a", "a/../b", "a..b"))) == (True, False, False, True)
    assert one(spark, labels.is_cacheable(lit(None).cast("boolean"), lit(True)), labels.is_cacheable(lit(True), lit(True)), labels.is_cacheable(lit(None).cast("boolean"), lit(False))) == (False, True, True)
    assert one(spark, *(labels.resolve_sandbox_path(lit(p), lit("/home/u"), lit("/ws")) for p in ("~/x", "/y", "z"))) == ("/home/u/x", "/y", "/ws/z")
    assert one(spark, labels.expand_env(F.array(lit("PATH"), lit("LC_ALL"), lit("LC_X")), ["LC_*", "HOME"]))[0] == ["HOME", "LC_ALL", "LC_X"]


@pytest.mark.parametrize(("kind", "good", "bad"), [("workspace", "a-b_1", "a.b"), ("target", "a.b c", "a:b"), ("task", "_a-1", "1a"), ("generator", "1a", "a/b"), ("segment", "a.b", ".a")])
def test_name_rules(spark, kind, good, bad):
    assert one(spark, labels.is_valid_name(F.lit(good), kind), labels.is_valid_name(F.lit(bad), kind), labels.is_valid_name(F.lit(""), kind)) == (True, False, False)


def test_hashes(spark):
    lit, h = F.lit, lambda s: hashlib.sha256(s).hexdigest()
    out = F.array(F.struct(lit("b").alias("path"), lit(h(b"2")).alias("content_hash")), F.struct(lit("a").alias("path"), lit(h(b"1")).alias("content_hash")))
    want = h(b"a\0" + bytes.fromhex(h(b"1")) + b"\0b\0" + bytes.fromhex(h(b"2")) + b"\0")
    empty = F.array().cast("array<struct<path:string,content_hash:string>>")
    assert one(spark, hashing.outputs_hash(out), hashing.outputs_hash(empty), hashing.content_hash(lit("é"))) == (want, h(b""), h("é".encode()))
    assert one(spark, hashing.decode_hash(lit(h(b"x"))), hashing.decode_hash(lit("ab"))) == (bytearray.fromhex(h(b"x")), None)


def test_cache_key_bytes(spark):
    lit, h = F.lit, lambda s: hashlib.sha256(s).digest()
    files = F.array(*(F.struct(lit(p).alias("path"), lit(h(p.encode()).hex()).alias("content_hash")) for p in ("a-b/x", "a/x")))
    deps = sorted([h(b"d1"), h(b"d2")])
    want = b"v3\0cmd\0make\0cwd\0pkg\0env\0A=1\0Z=2\0TARGET_TRIPLE=x86\0file_inputs\0" + b"".join(p.encode() + b"\0" + h(p.encode()) + b"\0" for p in ("a/x", "a-b/x")) + b"dep_outputs\0" + b"".join(d + b"\0" for d in deps)
    env = F.create_map(lit("Z"), lit("2"), lit("A"), lit("1"))
    assert one(spark, hashing.cache_key(lit("make"), lit("pkg"), env, files, F.array(*(lit(d.hex()) for d in deps[::-1])), "x86"))[0] == h(want).hex()


def test_text(spark):
    lit = F.lit
    assert one(spark, *(text.format_duration(lit(n)) for n in (999, 1000, 59_990, 90_000))) == ("999ms", "1.00s", "59.99s", "1.5m")
    assert one(spark, *(text.parse_duration(lit(s)) for s in ("90", "90s", "5m", "2h", "7d", "x", "5w"))) == (90, 90, 300, 7200, 604_800, None, None)
    assert one(spark, *(text.human_bytes(lit(n)) for n in (0, 1023, 1536, 5 * 1024**3))) == ("0 B", "1023 B", "1.5 KiB", "5.0 GiB")
    assert one(spark, text.short_hash(lit("ab" * 32)))[0] == "ab" * 8
    assert one(spark, text.display_cut(lit("é" * 5000)))[0] == "é" * 4096


@pytest.mark.parametrize("word", ["", "a", "//pkg:name", "é\x00" + "x" * 30])
def test_fnv(spark, word):
    h = 0xCBF29CE484222325
    for byte in word.encode():
        h = (h ^ byte) * 0x100000001B3 % 2**64
    assert one(spark, text.fnv1a(F.lit(word)), text.palette_slot(F.lit(word))) == (h, h % 8)


@pytest.mark.parametrize(
    ("code", "said", "network", "cause", "path"),
    [
        (125, "x", True, "setup", None), (1, "Landlock is off", True, "setup", None), (1, "getaddrinfo failed", False, "network", None), (1, "getaddrinfo failed", True, None, None),
        (1, "cat: /etc/x: Permission denied", True, "undeclared", "/etc/x"), (1, "open '/ws/a/b': Operation not permitted", True, "declared", "/ws/a/b"), (1, "EPERM", True, "denied", None),
        (1, "cc: foo.h: No such file or directory", True, "missing", None), (2, "assertion failed", True, None, None), (1, "/first line\nx: (/a/b), /a/bc: EACCES", True, "undeclared", "/a/bc"),
    ],
)
def test_diagnosis(spark, code, said, network, cause, path):
    got = one(spark, diagnose.diagnose(F.lit(code), F.lit(said), F.array(F.lit("/ws"), F.lit("/tmp")), F.lit(network)), diagnose.first_denied_path(F.lit(said)))
    assert got == (cause, path)
