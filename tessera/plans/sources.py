"""Queries of the operators on source files: parts stand for files in C++ and Java."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.checkpoints import cut, spread
from tessera.operators import code
from tessera.operators.chunking import Budget
from tessera.plans.registry import DAY, query, table

#: So few tokens that long functions are cut.
SMALL = Budget(target=60, hard=120, lines=12, repeat=3)


def _cpp(k: Column) -> Column:
    s = lambda c: c.cast("string")
    return F.concat(
        F.lit('#include "x.h"\n#define M(a) { \\\n  a\n// about '), s(k), F.lit("\nnamespace ns"), s(k % 5), F.lit(" {\n/* a } */ class C"), s(k), F.lit(" final : public B<int> {\npublic:\n  C"), s(k),
        F.lit("();\n  // runs\n  int run(int a) const { return a < "), s(k), F.lit(" ? 1 : 0; }\n"), F.when(k % 3 == 0, "  int run(double b) { char c = '{'; return 2; }\n").otherwise(""),
        F.lit("};\nvoid free"), s(k), F.lit('(const char* s = "};(");\n}\nint ns'), s(k % 5), F.lit("::C"), s(k), F.lit("::later(int x) {\n"), F.repeat(F.lit("  x += 1;\n"), (k % 60).cast("int")), F.lit("  return x;\n}\n"), F.when(k % 22 == 0, "void broken( {\n").otherwise(""),
    )


def _java(k: Column) -> Column:
    s = lambda c: c.cast("string")
    return F.concat(
        F.lit("package p.q"), s(k % 7), F.lit(";\n@D(v = {1})\npublic class J"), s(k), F.lit(" implements I {\n  enum E { A, B(1) { int x() { return 1; } }; int n() { return 0; } }\n"),
        F.lit('  private List<String> f = List.of("a{");\n  /** doc */\n  public <T> void go(T t) throws X { if (t == null) { return; } }\n'), F.when(k % 3 == 0, "  abstract int size();\n").otherwise(""), F.lit("}\n"),
    )


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.when(k % 10 == 9, F.concat(F.lit("int x"), k, F.lit(" = 1;\n"))).when(k % 2 == 0, _cpp(k)).otherwise(_java(k))
    path = F.concat(F.lit("src/f"), k, F.when(k % 10 == 9, ".h").when(k % 2 == 0, ".cpp").otherwise(".java"))
    parts = cut(spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey"))  # a filter on the texts would be moved before a mere shuffle
    files = parts.select(F.lit("repo").alias("repo"), path.alias("path"), text.alias("text"))
    return code.read_symbols(code.git_documents(files, "main", "c0"), SMALL)


#: Lines of the C++ files: 5 namespace, 6 class, 8 constructor, 9 and 10 run, then what depends on a second ``run``.
_SYMBOLS_SQL = """
p AS (SELECT p_partkey AS k, (p_partkey % 3 = 0)::INT AS m, p_partkey % 60 AS n FROM part WHERE p_partkey % 10 <> 9),
f AS (SELECT k, m, n, 'src/f' || k || CASE WHEN k % 2 = 0 THEN '.cpp' ELSE '.java' END AS path, CASE WHEN k % 2 = 0 THEN 'ns' || (k % 5) ELSE 'p.q' || (k % 7) END AS ns, CASE WHEN k % 22 = 0 THEN 'partial' ELSE 'ok' END AS status FROM p),
s AS (SELECT k, path, status, 'namespace' AS t, ns AS q, NULL AS up, 'namespace ' || ns AS sig, 4 AS a, 12 + m AS z, FALSE AS o FROM f WHERE k % 2 = 0
 UNION ALL SELECT k, path, status, 'class', ns || '::C' || k, ns, 'class C' || k || ' final : public B<int>', 6, 11 + m - 1, FALSE FROM f WHERE k % 2 = 0
 UNION ALL SELECT k, path, status, 'method', ns || '::C' || k || '::C' || k, ns || '::C' || k, 'C' || k || '();', 8, 8, FALSE FROM f WHERE k % 2 = 0
 UNION ALL SELECT k, path, status, 'method', ns || '::C' || k || '::run', ns || '::C' || k, 'int run(int a) const', 9, 10, m = 1 FROM f WHERE k % 2 = 0
 UNION ALL SELECT k, path, status, 'method', ns || '::C' || k || '::run', ns || '::C' || k, 'int run(double b)', 11, 11, TRUE FROM f WHERE k % 2 = 0 AND m = 1
 UNION ALL SELECT k, path, status, 'function', ns || '::free' || k, ns, 'void free' || k || '(const char* s = "};(");', 12 + m, 12 + m, FALSE FROM f WHERE k % 2 = 0
 UNION ALL SELECT k, path, status, 'method', ns || '::C' || k || '::later', ns || '::C' || k, 'int ' || ns || '::C' || k || '::later(int x)', 14 + m, 16 + m + n, FALSE FROM f WHERE k % 2 = 0
 UNION ALL SELECT k, path, status, 'package', ns, NULL, 'package ' || ns || ';', 1, 1, FALSE FROM f WHERE k % 2 = 1
 UNION ALL SELECT k, path, status, 'class', ns || '::J' || k, ns, '@D(v = {1})' || chr(10) || 'public class J' || k || ' implements I', 2, 8 + m, FALSE FROM f WHERE k % 2 = 1
 UNION ALL SELECT k, path, status, 'enum', ns || '::J' || k || '::E', ns || '::J' || k, 'enum E', 4, 4, FALSE FROM f WHERE k % 2 = 1
 UNION ALL SELECT k, path, status, 'method', ns || '::J' || k || '::E::n', ns || '::J' || k || '::E', 'int n()', 4, 4, FALSE FROM f WHERE k % 2 = 1
 UNION ALL SELECT k, path, status, 'method', ns || '::J' || k || '::go', ns || '::J' || k, 'public <T> void go(T t) throws X', 6, 7, FALSE FROM f WHERE k % 2 = 1
 UNION ALL SELECT k, path, status, 'method', ns || '::J' || k || '::size', ns || '::J' || k, 'abstract int size();', 8, 8, FALSE FROM f WHERE k % 2 = 1 AND m = 1),
fixed AS (SELECT k, path, status, t, q, up, sig, a, CASE WHEN t = 'class' AND k % 2 = 0 THEN 11 + (k % 3 = 0)::INT WHEN t = 'namespace' THEN 13 + (k % 3 = 0)::INT ELSE z END AS z, o FROM s)
"""


@query(f"""WITH {_SYMBOLS_SQL} SELECT 'repo:main:' || path || ':' || q || CASE WHEN o THEN '~' || substr(sha256(sig), 1, 8) ELSE '' END AS symbol_id, t AS symbol_type, q AS qualified_name, up AS parent_symbol, sig AS signature, a AS line_start, z AS line_end, status AS parse_status FROM fixed""")
def git_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What C++ and Java files declare, with braces in comments, literals, directives and initial values in the way."""
    return code.git_symbols(_read(spark, sf_dir), DAY).select("symbol_id", "symbol_type", "qualified_name", "parent_symbol", "signature", "line_start", "line_end", "parse_status")


@query(f"""WITH {_SYMBOLS_SQL}, mem AS (SELECT k, up, string_agg(sig, chr(10) ORDER BY a, sig DESC) AS sigs FROM fixed WHERE up IS NOT NULL GROUP BY k, up),
x AS (SELECT f.k, f.path, f.q, '// repo · ' || path || ' · ' || q || CASE WHEN t = 'namespace' THEN chr(10) || chr(10) || '// about ' || f.k ELSE '' END || chr(10) || chr(10) || sig || coalesce(chr(10) || sigs, '') AS txt FROM fixed f LEFT JOIN mem m ON m.k = f.k AND m.up = f.q WHERE t IN ('namespace', 'class', 'enum', 'package'))
SELECT q AS symbol, path AS file_path, sha256(txt) AS content_hash, 'chunk:git:' || substr(sha256(concat_ws(chr(31), 'git', 'git:repo:' || path, q, txt)), 1, 16) AS chunk_id FROM x""")
def symbol_member_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of classes, namespaces and packages: their own signature and those of their members."""
    rows = code.opening_chunks(_read(spark, sf_dir), ("namespace", "class", "enum", "package"))
    return rows.select("symbol", "file_path", "content_hash", "chunk_id")


@query("""WITH p AS (SELECT p_partkey AS k, (p_partkey % 3 = 0)::INT AS m, p_partkey % 60 + 3 AS l FROM part),
c AS (SELECT *, CASE WHEN k % 10 = 9 OR k % 2 = 1 THEN 0 WHEN l <= 0 THEN 0 ELSE 1 END AS cpp FROM p)
SELECT count(*) AS files, sum(CASE WHEN k % 10 = 9 THEN 0 WHEN k % 2 = 0 THEN 6 + m ELSE 5 + m END)::BIGINT AS symbols, sum((k % 22 = 0 AND k % 10 <> 9)::INT)::BIGINT AS partial, sum((k % 10 = 9)::INT)::BIGINT AS fallback FROM c""")
def symbol_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.symbol_metrics(_read(spark, sf_dir)).select("files", "symbols", "partial", "fallback")
