"""Queries over texts: parsing, comparison, rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from evoframe.functions import metrics as M
from evoframe.functions import text as T
from evoframe.plans import views
from evoframe.plans.catalogue import query

def _d(spark, sf):
    return views.read(spark, sf, "documents")


@query("SELECT page_id, coalesce(nullif(regexp_extract(html, '<title>([\\s\\S]*?)</title>', 1), ''), html) AS title FROM pages")
def tag_extract(spark, sf):
    return views.read(spark, sf, "pages").select("page_id", T.tag(F.col("html"), "title").alias("title"))


@query("""SELECT doc_id, 'line ' || doc_id || ' x' AS body FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'no fence ' || doc_id FROM documents WHERE doc_id % 2 = 1""")
def fence_extract(spark, sf):
    i = F.col("doc_id").cast("string")
    text = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("a\n```python\nline "), i, F.lit(" x\n```\nb"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("```\nline "), i, F.lit(" x\n``` tail"))).otherwise(F.concat(F.lit("no fence "), i))
    return _d(spark, sf).select("doc_id", T.fenced(text, "python").alias("body"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN NULL ELSE '{\"a\": ' || doc_id || '}' END AS body FROM documents")
def json_extract(spark, sf):
    i = F.col("doc_id").cast("string")
    obj = F.concat(F.lit('{"a": '), i, F.lit("}"))
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("x ```json\n"), obj, F.lit("\n``` y"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("see "), obj, F.lit(" end"))).otherwise(F.lit("none"))
    return _d(spark, sf).select("doc_id", T.braces(text).alias("body"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN '{"a": ' || doc_id || '}' END AS value, CASE WHEN doc_id % 4 = 3 THEN 'No JSON code blocks found in the response.' END AS error FROM documents""")
def json_tolerant(spark, sf):
    i = F.col("doc_id").cast("string")
    text = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("```json\n{\"a\": 1}\n```\n```json\n{\"a\": "), i, F.lit("}\n```")))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("```json\n{\"a\": "), i, F.lit(" // note\n}\n```")))
        .when(F.col("doc_id") % 4 == 2, F.concat(F.lit("```json\n{'a': "), i, F.lit("}\n```"))).otherwise(F.lit("nothing"))
    )
    return _d(spark, sf).select("doc_id", T.tolerant_json_column(text).alias("j")).select("doc_id", "j.value", "j.error")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN 'do ' || doc_id END AS query, CASE WHEN doc_id % 3 > 0 THEN 'none' END AS init, CASE WHEN doc_id % 3 > 0 THEN 'QA' END AS type,
CASE WHEN doc_id % 3 > 0 THEN 'check/integer-match.py' END AS comparison_method FROM documents""")
def template_parse(spark, sf):
    i = F.col("doc_id").cast("string")
    text = F.concat(F.lit("### Query:\n do "), i, F.lit(" \n\n### Init:\nnone\n\n### Type:\nQA\n\n### Comparison_method:\ncheck/integer-match.py\n\nrest"))
    fields = T.template_fields(F.when(F.col("doc_id") % 3 > 0, text).otherwise(F.lit("### Query: x")), ("Query", "Init", "Type", "Comparison_method"))
    return _d(spark, sf).select("doc_id", fields.alias("f")).select("doc_id", "f.query", "f.init", "f.type", "f.comparison_method")


@query("SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN doc_id % 7 END AS score, CASE WHEN doc_id % 5 > 0 THEN CAST(4 AS BIGINT) END AS total FROM documents")
def judge_summary(spark, sf):
    i = (F.col("doc_id") % 7).cast("string")
    text = F.concat(F.lit("Score: "), i, F.lit("\nTest cases done: 3\nTest cases correct: 2\nTest cases total: 4"))
    s = T.judge_summary(F.when(F.col("doc_id") % 5 > 0, text).otherwise(F.lit("Score: 1")))
    return _d(spark, sf).select("doc_id", s["score"].alias("score"), s["total"].alias("total"))


_WHITE = r"[\s\x0B\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


@query(f"""WITH plain AS (SELECT doc_id, regexp_replace(text || chr(27) || '[31m Password= abc' || chr(27) || '[0m' || doc_id || ' token:x', '\\x1B(?:[@-Z\\\\-_]|\\[[0-?]*[ -/]*[@-~])', '', 'g') AS text FROM documents)
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9]{{32,}}', '<REDACTED_TOKEN>', 'gi'), 'sk-[A-Za-z0-9]{{48}}', '<REDACTED_API_KEY>', 'gi'),
'password[=:]{_WHITE}*{_WHITE.replace("[", "[^", 1)}+', 'password=<REDACTED>', 'gi'), 'token[=:]{_WHITE}*{_WHITE.replace("[", "[^", 1)}+', 'token=<REDACTED>', 'gi') AS text FROM plain""")
def redact(spark, sf):
    return _redacted(_d(spark, sf))


def _redacted(docs):
    text = F.concat("text", F.lit("\x1b[31m Password= abc\x1b[0m"), F.col("doc_id").cast("string"), F.lit(" token:x"))
    return docs.select("doc_id", T.redacted(text).alias("text"))


@query("SELECT doc_id, 'a' || chr(10) || doc_id || chr(10) || 'b' AS text FROM documents")
def normalize_newlines(spark, sf):
    return _d(spark, sf).select("doc_id", T.newlines(F.concat(F.lit(" \r\na\r\n"), F.col("doc_id").cast("string"), F.lit("\rb \n"))).alias("text"))


@query("""SELECT doc_id, '## Last Execution Output' || chr(10) || chr(10) || '### log' || chr(10) || '```' || chr(10) || CASE WHEN length(text) > 100 THEN left(text, 100) || chr(10) || '... (truncated)' ELSE text END || chr(10) || '```' AS report FROM documents""")
def artifact_render(spark, sf):
    return _d(spark, sf).select("doc_id", T.artifact_report(F.array(T.artifact_section(F.lit("log"), F.col("text"), 100))).alias("report"))


@query("SELECT doc_id, CASE WHEN strlen(text) <= 2000 THEN 'inline' ELSE 'file' END AS route, strlen(text) AS size FROM documents")
def artifact_route(spark, sf):
    from evoframe.sources.storage import routed

    a = _d(spark, sf).select(F.col("doc_id").alias("program_id"), F.lit("log").alias("key"), F.col("text").cast("binary").alias("content"))
    return routed(a, 2000).select(F.col("program_id").alias("doc_id"), "route", "size")


@query("SELECT doc_id % 50 AS program_id, sum(strlen(text))::BIGINT AS total, count(*) AS n FROM documents GROUP BY 1")
def artifact_sizes(spark, sf):
    from evoframe.sources.storage import artifact_sizes as sizes

    return sizes(_d(spark, sf).select((F.col("doc_id") % 50).alias("program_id"), F.col("text").cast("binary").alias("content")))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'artifact' ELSE 'a.b_' || doc_id || '-c' END AS name FROM documents")
def sanitize_key(spark, sf):
    key = F.when(F.col("doc_id") % 4 == 0, "/*?").otherwise(F.concat(F.lit("a.b_/"), F.col("doc_id").cast("string"), F.lit(" -c")))
    return _d(spark, sf).select("doc_id", T.safe_file_name(key).alias("name"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN doc_id % 5 = doc_id % 3 WHEN 1 THEN false ELSE true END AS same FROM documents""")
def answer_compare(spark, sf):
    i = F.col("doc_id")
    method = F.when(i % 3 == 2, "check/string-match.py").otherwise("check/integer-match.py")
    answer = F.when(i % 3 == 0, F.concat(F.lit(" +"), (i % 5).cast("string"), F.lit(" "))).when(i % 3 == 1, "42.0").otherwise("a\r\nb ")
    truth = F.when(i % 3 == 0, (i % 3).cast("string")).when(i % 3 == 1, "42").otherwise("a\nb")
    return _d(spark, sf).select("doc_id", T.answers_match(method, answer, truth).alias("same"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN doc_id * 1024 WHEN 1 THEN doc_id WHEN 2 THEN doc_id * 1048576 ELSE NULL END AS bytes FROM documents")
def size_parse(spark, sf):
    i = F.col("doc_id").cast("string")
    unit = F.when(F.col("doc_id") % 4 == 0, "KB").when(F.col("doc_id") % 4 == 1, "").when(F.col("doc_id") % 4 == 2, "M").otherwise("XB")
    return _d(spark, sf).select("doc_id", T.size_in_bytes(F.concat(i, unit)).cast("long").alias("bytes"))


#: One line for each sign of a language, and some without any.
_CODE = [
    "import os", "from os import path", "def f():", "class A:", "package a;", "import java.util.List;", "public class A {", "#include <a>", "int main() {", "void main() {",
    "function f() {", "var a", "let a", "const a", "console.log(1)", "module a", "fn main() {", "let mut a", "impl A {", "SELECT 1", "CREATE TABLE t", "INSERT INTO t", "hello", " def f():",
]


def _sql_list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@query(f"""WITH code AS (SELECT doc_id, text || chr(10) || {_sql_list(_CODE)}[doc_id % {len(_CODE)} + 1] || chr(10) AS t FROM documents)
SELECT doc_id, CASE {" ".join(f"WHEN regexp_matches(t, '(?m)^{sign}') THEN '{name}'" for name, sign in T.LANGUAGE_SIGNS)} ELSE 'unknown' END AS language FROM code""")
def language_detect(spark, sf):
    line = F.element_at(F.array(*[F.lit(x) for x in _CODE]), (F.col("doc_id") % len(_CODE) + 1).cast("int"))
    return _d(spark, sf).select("doc_id", T.code_language(F.concat("text", F.lit("\n"), line, F.lit("\n"))).alias("language"))


_EXTENSIONS = [*T.EXTENSIONS, ".C", ".H", ".h", ".PY", ".none", ""]


def _files(spark, sf):
    """Each document as a submission of three files, by turns of every extension; their texts begin by turns like old, new and other programs."""
    i = F.col("doc_id")
    ext = F.element_at(F.array(*[F.lit(x) for x in _EXTENSIONS]), (i % len(_EXTENSIONS) + 1).cast("int"))
    head = F.element_at(F.array(*[F.lit(x) for x in _HEADS]), (i % len(_HEADS) + 1).cast("int"))
    first = F.struct(F.lit(0).alias("pos"), F.concat(F.lit("a/first"), ext).alias("name"), F.concat(head, F.lit("\n"), "text").alias("content"))
    second = F.struct(F.lit(1).alias("pos"), F.when(i % 7 == 0, "b.c").otherwise("b.txt").alias("name"), F.when(i % 3 == 0, "fun main(").when(i % 3 == 1, "  program p").otherwise("x").alias("content"))
    third = F.struct(F.lit(2).alias("pos"), F.when(i % 5 == 0, "c/Main.x").otherwise("c/other.x").alias("name"), F.lit("y").alias("content"))
    return _d(spark, sf).select("doc_id", F.explode(F.array(first, second, third)).alias("f")).select("doc_id", "f.*")


_HEADS = ["#!/usr/bin/python2", "#!/usr/bin/python3", "print 'x'", "print('x')  # print 'x'", "x = raw_input()", "plain"]
_FILES = rf"""submissions AS (SELECT doc_id, {_sql_list(_EXTENSIONS)}[doc_id % {len(_EXTENSIONS)} + 1] AS ext, {_sql_list(_HEADS)}[doc_id % {len(_HEADS)} + 1] || chr(10) || text AS content FROM documents),
languages AS (SELECT doc_id, CASE WHEN ext = '.C' THEN 'C++' WHEN lower(ext) = '.h' THEN CASE WHEN doc_id % 7 = 0 OR ext = '.c' THEN 'C' ELSE 'C++' END
WHEN lower(ext) = '.py' AND (doc_id % {len(_HEADS)} IN (0, 2, 4) OR (doc_id % {len(_HEADS)} <> 1 AND regexp_matches(content, '(?m)^[^#\n]*\braw_input\b|^[^\S\n]*print\b *[^ (),\]#\n]'))) THEN 'Python 2'
ELSE map_extract_value(MAP {{{", ".join(f"'{k}': '{v}'" for k, v in T.EXTENSIONS.items())}}}, lower(ext)) END AS language, ext FROM submissions)"""


@query(f"WITH {_FILES} SELECT doc_id, language FROM languages")
def language_guess(spark, sf):
    from evoframe.operators.judge import languages

    return languages(_files(spark, sf), "doc_id")


@query(rf"""WITH {_FILES}, mains AS (SELECT doc_id, language, ext, CASE WHEN doc_id % 5 = 0 THEN 'c/Main.x' WHEN language IN ('Java', 'Rust', 'Scala', 'Kotlin') AND doc_id % 3 = 0 THEN CASE WHEN doc_id % 7 = 0 THEN 'b.c' ELSE 'b.txt' END
WHEN language = 'Pascal' AND doc_id % 3 = 1 THEN CASE WHEN doc_id % 7 = 0 THEN 'b.c' ELSE 'b.txt' END ELSE 'a/first' || ext END AS main_file FROM languages),
bases AS (SELECT *, regexp_replace(main_file, '^.*/', '') AS base, regexp_replace(regexp_replace(main_file, '^.*/', ''), '(.)\.[^.]*$', '\1') AS stem FROM mains)
SELECT doc_id, language, main_file, CASE WHEN language IN ({", ".join(f"'{x}'" for x in T.MAIN_FILE)}) THEN base WHEN language = 'Kotlin' THEN upper(left(stem, 1)) || substr(stem, 2) || 'Kt'
WHEN language IN ({", ".join(f"'{x}'" for x in T.MAIN_CLASS)}) THEN stem END AS main FROM bases""")
def main_file(spark, sf):
    from evoframe.operators.judge import languages, main_files

    files = _files(spark, sf)
    return main_files(files.join(languages(files, "doc_id"), "doc_id"), "doc_id")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN doc_id END AS submission, CASE WHEN doc_id % 2 = 0 THEN doc_id % 10 || '.5' ELSE '' END AS score FROM documents""")
def submission_id(spark, sf):
    i = F.col("doc_id")
    answer = F.when(i % 3 > 0, F.concat(F.lit("Submission received. Submission ID: "), i.cast("string"), F.lit(".\n"))).otherwise("Submission refused")
    status = F.when(i % 2 == 0, F.concat(F.lit("Accepted ("), (i % 10).cast("string"), F.lit(".5)"))).otherwise("Wrong (none)")
    return _d(spark, sf).select("doc_id", T.submission_id(answer).alias("submission"), T.shown_score(status).alias("score"))


@query("SELECT p_partkey, 'agent-' || replace('v1.' || p_partkey, '.', '_') || '-3' || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '-ground_truth' END AS id FROM part")
def runtime_id(spark, sf):
    inst = F.concat(F.lit("v1."), F.col("p_partkey").cast("string"))
    return views.read(spark, sf, "part").select("p_partkey", T.runtime_id(inst, F.lit("3"), F.when(F.col("p_partkey") % 2 == 1, "ground_truth")).alias("id"))


@query("SELECT doc_id, 'ab' || doc_id || 'Xcd' AS text FROM documents")
def stop_truncate(spark, sf):
    return _d(spark, sf).select("doc_id", T.truncated_at(F.concat(F.lit("ab"), F.col("doc_id").cast("string"), F.lit("XcdY")), F.array(F.lit("Y"), F.lit("X"))).alias("text"))


@query("SELECT doc_id, 'mkdir -p a' || doc_id || '; mkdir -p b' AS text FROM documents")
def mkdir_safe(spark, sf):
    return _d(spark, sf).select("doc_id", T.safe_mkdir(F.concat(F.lit("mkdir a"), F.col("doc_id").cast("string"), F.lit("; mkdir -p b"))).alias("text"))


_DIFF = "x\n<<<<<<< SEARCH\nold {i}  \n=======\nnew {i}\n>>>>>>> REPLACE\ny\n<<<<<<< SEARCH\nb\nc\n=======\nd\n>>>>>>> REPLACE\n"


def _diff(i):
    return F.replace(F.lit(_DIFF), F.lit("{i}"), i.cast("string"))


@query("SELECT doc_id, 'old ' || doc_id AS search, 'new ' || doc_id AS replacement FROM documents UNION ALL SELECT doc_id, 'b' || chr(10) || 'c', 'd' FROM documents")
def diff_extract(spark, sf):
    return _d(spark, sf).select("doc_id", F.explode(T.diff_blocks(_diff(F.col("doc_id")))).alias("b")).select("doc_id", "b.search", F.col("b.replace").alias("replacement"))


@query("SELECT doc_id, 'a' || chr(10) || 'new ' || doc_id || chr(10) || 'd' || chr(10) || 'b' AS code FROM documents")
def diff_apply(spark, sf):
    code = F.concat(F.lit("a\nold "), F.col("doc_id").cast("string"), F.lit("\nb\nc\nb"))
    return _d(spark, sf).select("doc_id", T.apply_blocks(code, T.diff_blocks(_diff(F.col("doc_id")))).alias("code"))


@query("SELECT doc_id, 'Change 1: ''old ' || doc_id || ''' to ''new ' || doc_id || '''' || chr(10) || 'Change 2: Replace 2 lines with d' AS summary FROM documents")
def diff_summary(spark, sf):
    return _d(spark, sf).select("doc_id", T.diff_summary(T.diff_blocks(_diff(F.col("doc_id")))).alias("summary"))


@query("SELECT doc_id, 1 AS start, 4 AS stop, 'x' || chr(10) || doc_id AS content FROM documents")
def evolve_blocks(spark, sf):
    code = F.concat(F.lit("a\n# EVOLVE-BLOCK-START\nx\n"), F.col("doc_id").cast("string"), F.lit("\n# EVOLVE-BLOCK-END\nb\n# EVOLVE-BLOCK-START\nopen"))
    return _d(spark, sf).select("doc_id", F.explode(T.evolve_blocks(code)).alias("b")).select("doc_id", "b.start", F.col("b.end").alias("stop"), "b.content")


@query()
def edit_distance(spark, sf):
    """Whole texts of neighbours; too slow in SQL, so held against brute force in tests/test_whole_job.py."""
    d = _d(spark, sf).select("doc_id", "text")
    b = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    # Dealt out, as a join of few documents would otherwise be a single task of long work.
    return d.join(b, "doc_id").repartition("doc_id").select("doc_id", T.whole_edit_distance(F.col("text"), F.col("other")).alias("distance"))


@query("""SELECT id, string_agg(key || '=' || printf('%.4f', value), ', ' ORDER BY key) AS text FROM (SELECT id, key, value FROM metric_rows UNION ALL SELECT doc_id, 'noise', 'nan'::DOUBLE FROM documents WHERE doc_id % 97 = 0) GROUP BY id""")
def metric_format(spark, sf):
    return views.programs(spark, sf, code=False).select("id", M.formatted(F.col("metrics")).alias("text"))


@query("SELECT doc_id, CASE doc_id % 18 WHEN 0 THEN 'New' WHEN 1 THEN 'New' WHEN 2 THEN 'Waiting for compile' WHEN 3 THEN 'Compiling' WHEN 4 THEN 'Waiting for run' WHEN 5 THEN 'Running' WHEN 6 THEN 'Judge Error' WHEN 8 THEN 'Compile Error' WHEN 9 THEN 'Run Time Error' WHEN 10 THEN 'Memory Limit Exceeded' WHEN 11 THEN 'Output Limit Exceeded' WHEN 12 THEN 'Time Limit Exceeded' WHEN 13 THEN 'Illegal Function' WHEN 14 THEN 'Wrong Answer' WHEN 16 THEN 'Accepted' ELSE 'Unknown status ' || (doc_id % 18) END AS status FROM documents")
def status_text(spark, sf):
    return _d(spark, sf).select("doc_id", T.status_text(F.col("doc_id") % 18).alias("status"))


@query("SELECT doc_id, doc_id % 4 AS accepted, CAST(4 AS BIGINT) AS total FROM documents")
def judge_counts(spark, sf):
    mark = lambda ok: F.when(ok, '<i class="accepted">').otherwise('<i class="">')
    k = F.col("doc_id") % 4
    html = F.concat(*[mark(k > i) for i in range(4)], F.lit("<i>"))
    c = T.accepted_cases(html)
    return _d(spark, sf).select("doc_id", c["accepted"].alias("accepted"), c["total"].alias("total"))


@query("SELECT task, CAST(value AS DOUBLE) AS value FROM (VALUES ('t0', 0.5), ('t1', 0.25)) t(task, value)")
def headline_metric(spark, sf):
    rows = spark.createDataFrame([("t0", 0, "name", None), ("t0", 1, "acc", 0.5), ("t0", 2, "f1", 0.75), ("t1", 0, "em", 0.25)], "task string, pos int, metric string, value double")
    return rows.where("value is not null").groupBy("task").agg(F.min_by("value", "pos").alias("value"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS text FROM pages")
def html_text(spark, sf):
    return views.read(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("text"))


@query("SELECT doc_id, 'doc ' || doc_id || ': ' || left(text, 300) AS text FROM documents")
def progress_text(spark, sf):
    return _d(spark, sf).select("doc_id", F.format_string("doc %d: %s", "doc_id", F.left("text", F.lit(300))).alias("text"))


@query("SELECT instance_id, CASE WHEN type = 'QA' THEN 'question' WHEN type = 'EXEC' THEN 'task' ELSE 'other' END AS prompt FROM instances")
def prompt_choice(spark, sf):
    return views.instances(spark, sf).select("instance_id", F.when(F.col("type") == "QA", "question").when(F.col("type") == "EXEC", "task").otherwise("other").alias("prompt"))


@query("SELECT doc_id FROM documents WHERE length(text) <= 1000")
def length_gate(spark, sf):
    return _d(spark, sf).where(F.length("text") <= 1000).select("doc_id")


@query("SELECT doc_id, (doc_id % 2 = 0) = (doc_id % 3 = 0) AS fits FROM documents")
def shape_check(spark, sf):
    starter = F.when(F.col("doc_id") % 2 == 0, "").otherwise("class")
    value = F.parse_json(F.when(F.col("doc_id") % 3 == 0, '"1 2"').otherwise('{"a": 1}'))
    return _d(spark, sf).select("doc_id", ((starter == "") == (F.schema_of_variant(value) == "STRING")).alias("fits"))


@query("SELECT doc_id, contains(text, 'the') AS ok FROM documents")
def starter_check(spark, sf):
    return _d(spark, sf).select("doc_id", F.contains("text", F.lit("the")).alias("ok"))


@query("SELECT doc_id, doc_id % 3 = 1 AS fatal FROM documents")
def error_class(spark, sf):
    error = F.when(F.col("doc_id") % 3 == 1, "x AgentRuntimeBuildError: y").when(F.col("doc_id") % 3 == 2, "ValueError")
    return _d(spark, sf).select("doc_id", T.is_fatal(error).alias("fatal"))


@query("SELECT doc_id, doc_id % 4 <> 0 AND doc_id % 6 <> 0 AS complete FROM documents")
def completeness(spark, sf):
    flags = F.array(F.col("doc_id") % 4 != 0, F.col("doc_id") % 6 != 0)
    return _d(spark, sf).select("doc_id", F.forall(flags, lambda x: x).alias("complete"))


@query("SELECT doc_id, 'b' || doc_id AS output, 2 AS inputs FROM documents")
def io_columns(spark, sf):
    i = F.col("doc_id").cast("string")
    pairs = F.array(*[F.struct(F.concat(F.lit(n), i).alias("symbol"), F.lit(p).alias("property")) for n, p in (("a", "V"), ("b", "O"), ("c", "V"))])
    outputs, inputs = F.filter(pairs, lambda x: x["property"] == "O"), F.filter(pairs, lambda x: x["property"] == "V")
    return _d(spark, sf).where(F.size(outputs) == 1).select("doc_id", F.get(outputs, F.lit(0))["symbol"].alias("output"), F.size(inputs).alias("inputs"))


@query("SELECT doc_id, doc_id % 100 + 8000 AS port FROM documents UNION ALL SELECT doc_id, 443 FROM documents")
def port_parse(spark, sf):
    line = F.concat(F.lit("COMMAND PID USER FD TYPE DEVICE SIZE NODE NAME\nsrv 1 u 3u IPv4 0 0t0 TCP *:"), (F.col("doc_id") % 100 + 8000).cast("string"), F.lit("->1.2.3.4:443 (LISTEN)\nshort line\nsrv 2 u 3u IPv4 0 0t0 TCP *:x (L)"))
    return _d(spark, sf).select("doc_id", F.explode(T.ports(line).cast("array<long>")).alias("port"))


@query("SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 1, 3), chr(10)) AS text FROM documents")
def snippet(spark, sf):
    return _d(spark, sf).select("doc_id", F.array_join(F.slice(F.split("text", "\n"), 1, 3), "\n").alias("text"))


@query("SELECT event_id, date_diff('second', TIMESTAMP '2020-01-01', date_trunc('second', ts)) AS seconds FROM events")
def elapsed(spark, sf):
    e = views.read(spark, sf, "events")
    return e.select("event_id", F.timestamp_diff("SECOND", F.lit("2020-01-01").cast("timestamp"), F.date_trunc("second", "ts").cast("timestamp")).alias("seconds"))


@query("SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS stamp FROM events")
def stamp(spark, sf):
    return views.read(spark, sf, "events").select("event_id", F.date_format("ts", "yyyyMMddHHmmss").alias("stamp"))


@query("SELECT doc_id, [doc_id, doc_id + 1, doc_id + 2][1] AS first, [doc_id, doc_id + 1, doc_id + 2][-1] AS last, doc_id + 1 AS second_of_reverse, 7::BIGINT AS missing FROM documents")
def map_array_access(spark, sf):
    i = F.col("doc_id")
    a, m = F.array(i, i + 1, i + 2), F.create_map(F.lit("a"), i)
    return _d(spark, sf).select(
        "doc_id", F.get(a, F.lit(0)).alias("first"), F.try_element_at(a, F.lit(-1)).alias("last"), F.get(F.reverse(a), F.lit(1)).alias("second_of_reverse"),
        F.coalesce(F.try_element_at(m, F.lit("b")), F.lit(7).cast("long")).alias("missing"),
    )


@query("SELECT doc_id, regexp_replace(element_at_path, ':', '_') AS name FROM (SELECT doc_id, 'm' || doc_id || ':x' AS element_at_path FROM documents)")
def path_safe(spark, sf):
    return _d(spark, sf).select("doc_id", T.path_safe(F.concat(F.lit("org/m"), F.col("doc_id").cast("string"), F.lit(":x"))).alias("name"))


@query("SELECT doc_id, chr(65533) || chr(65533) || text AS text FROM documents")
def byte_decode(spark, sf):
    return _d(spark, sf).select("doc_id", T.decoded(F.concat(F.unhex(F.lit("FFFE")), F.col("text").cast("binary"))).alias("text"))


@query("""SELECT doc_id % 20 AS program_id, '{' || string_agg('"k' || doc_id || '":' || CASE WHEN doc_id % 2 = 0 THEN '"{\\"__bytes__\\":\\"//4=\\"}"' ELSE '"text"' END, ',' ORDER BY 'k' || doc_id) || '}' AS artifacts_json FROM documents GROUP BY 1""")
def json_encode_bytes(spark, sf):
    from evoframe.sources.storage import inline_json

    a = _d(spark, sf).select((F.col("doc_id") % 20).alias("program_id"), F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("key"), F.when(F.col("doc_id") % 2 == 0, F.unhex(F.lit("FFFE"))).otherwise(F.lit("text").cast("binary")).alias("content"))
    return inline_json(a)


_TEXTS = """texts AS (SELECT id, string_agg('- ' || key || ': ' || printf('%.4f', value), chr(10) ORDER BY key) AS measures, string_agg(key || '=' || printf('%.4f', value), ', ' ORDER BY key) AS line,
string_agg(key || ': ' || printf('%.4f', value), ', ' ORDER BY key) AS told FROM (SELECT id, key, value FROM metric_rows UNION ALL SELECT doc_id, 'noise', 'nan'::DOUBLE FROM documents WHERE doc_id % 97 = 0) GROUP BY id)"""


@query(f"""WITH {_TEXTS}, h AS (SELECT p.parent_id AS id, t.line, row_number() OVER (PARTITION BY p.parent_id ORDER BY p.seq DESC) AS k FROM programs p JOIN texts t USING (id) WHERE p.parent_id IS NOT NULL),
l AS (SELECT id, string_agg('Attempt ' || k || ': ' || line, chr(10) ORDER BY k) AS history FROM h WHERE k <= 3 GROUP BY id)
SELECT p.id, '# Current program' || chr(10) || t.measures || chr(10) || chr(10) || '```' || p.language || chr(10) || p.code || chr(10) || '```' || chr(10) || chr(10) || '# Attempts' || chr(10) || coalesce(l.history, '')
|| chr(10) || chr(10) || chr(10) || chr(10) || 'Improve the program.' AS prompt FROM programs p JOIN texts t USING (id) LEFT JOIN l USING (id)""")
def prompt_build(spark, sf):
    from evoframe.plans.prompts import prompts

    p = views.programs(spark, sf, code=True)
    history = p.where("parent_id is not null").select(F.col("parent_id").alias("id"), "seq", "metrics")
    return prompts(p.withColumn("artifacts", F.lit("")), history)


@query(f"""WITH {_TEXTS}, tries AS (SELECT c.parent_id AS id, c.seq, t.told, row_number() OVER (PARTITION BY c.parent_id ORDER BY c.seq) AS n, row_number() OVER (PARTITION BY c.parent_id ORDER BY c.seq DESC) AS k FROM programs c JOIN texts t USING (id) WHERE c.parent_id IS NOT NULL),
told AS (SELECT id, string_agg('### Attempt ' || n || chr(10) || '- Changes: change ' || seq || chr(10) || '- Measures: ' || told || chr(10) || '- Outcome: ' || outcome, chr(10) || chr(10) ORDER BY k) AS attempts FROM tries JOIN (
  SELECT m.seq, CASE WHEN bool_and(m.value > 0) THEN 'Improvement in all metrics' WHEN bool_and(m.value < 0) THEN 'Regression in all metrics' ELSE 'Mixed results' END AS outcome
  FROM (SELECT seq, value FROM metric_rows UNION ALL SELECT doc_id, 0.0 FROM documents WHERE doc_id % 97 = 0) m GROUP BY m.seq) o USING (seq) WHERE k <= 3 GROUP BY id)
SELECT id, coalesce(attempts, '') AS attempts FROM programs LEFT JOIN told USING (id)""")
def attempts_told(spark, sf):
    from evoframe.plans.prompts import Sampler
    from evoframe.plans.prompts import attempts_told as told

    p = views.programs(spark, sf, code=False)
    # A NaN is above every number here, as it is in Spark; with 0 as the other engine's stand-in it makes results mixed, so noise is left out of the comparison by a parent's NaN.
    none = F.when(F.map_contains_key("metrics", F.lit("noise")), F.create_map(F.lit("noise"), F.lit(float("nan")))).otherwise(F.create_map().cast("map<string,double>"))
    tries = p.where("parent_id is not null").select(F.col("parent_id").alias("id"), "seq", "metrics", none.alias("parent_metrics"), F.concat(F.lit("change "), F.col("seq").cast("string")).alias("changes"))
    return p.select("id").join(told(tries, Sampler()).select("id", "attempts"), "id", "left").select("id", F.coalesce("attempts", F.lit("")).alias("attempts"))


@query("SELECT doc_id AS id, 'ask ' || doc_id || ' #5' AS reply, CAST(3 AS BIGINT) AS tries FROM documents")
def reply_retry(spark, sf):
    from evoframe.plans.prompts import asked

    rows = _d(spark, sf).select(F.col("doc_id").alias("id"), F.concat(F.lit("ask "), F.col("doc_id").cast("string")).alias("prompt"))
    return asked(rows, _echo, _needs_two_errors)


def _echo(turns):
    return f"{turns[0][1]} #{len(turns)}"


def _needs_two_errors(text):
    return None if text.endswith("#5") else "again"


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN doc_id / 2.0 WHEN 1 THEN 0.0 WHEN 2 THEN 0.0 ELSE -1.5 END AS value, round(-log10(doc_id % 50 / 7.0 + 1e-9), 9) AS score FROM documents")
def safe_numbers(spark, sf):
    """Casts that can't fail, and a loss as a score."""
    i = F.col("doc_id")
    text = F.when(i % 4 == 0, (i / 2.0).cast("string")).when(i % 4 == 1, "none").when(i % 4 == 3, " -1.5 ")
    return _d(spark, sf).select("doc_id", M.safe_double(text).alias("value"), F.round(M.log_error(i % 50 / 7.0), 9).alias("score"))


@query("SELECT l_orderkey, l_linenumber, l_quantity * 2.0 + l_discount * -3.5 + 0.25 AS value FROM lineitem")
def linear_model(spark, sf):
    x = F.array(F.col("l_quantity").cast("double"), F.col("l_discount").cast("double"), F.lit(1.0))
    p = F.array(F.lit(2.0), F.lit(-3.5), F.lit(0.25))
    return views.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", M.linear_model(x, p).alias("value"))


@query("SELECT doc_id, ['one', 'two', 'three'][CAST(floor(('0x' || substr(md5('v|' || doc_id), 1, 8))::BIGINT / 4294967296.0 * 3) AS INTEGER) + 1] AS choice FROM documents")
def prompt_variation(spark, sf):
    from evoframe.plans.prompts import variation

    return _d(spark, sf).select("doc_id", variation(["one", "two", "three"], "v", F.col("doc_id")).alias("choice"))


@query("SELECT p_size, CAST(count(*) FILTER (WHERE p_partkey % 3 = 0) AS BIGINT) AS successful, CAST(count(*) FILTER (WHERE p_partkey % 3 = 1) AS BIGINT) AS skipped, CAST(count(*) FILTER (WHERE p_partkey % 3 = 2 AND p_partkey % 2 = 0) AS BIGINT) AS errors FROM part GROUP BY 1")
def job_counts(spark, sf):
    """Counts of job messages by what they say."""
    i = F.col("p_partkey")
    message = F.when(i % 3 == 0, F.concat(F.lit("Successfully processed "), i.cast("string"))).when(i % 3 == 1, "Skipped, done").when(i % 2 == 0, "Error processing it").otherwise("other")
    return views.read(spark, sf, "part").groupBy("p_size").agg(*[F.count_if(F.contains(message, F.lit(sign))).alias(name) for name, sign in T.JOB_SIGNS.items()])


@query("SELECT item_id, text FROM benchmark WHERE item_id >= 10 AND item_id < 90 AND item_id % 2 = 1")
def benchmark_release(spark, sf):
    """Items of a release within a range."""
    from evoframe.operators.relational import released

    rows = views.read(spark, sf, "benchmark").withColumn("release", F.concat(F.lit("v"), (F.col("item_id") % 2).cast("string")))
    return released(rows, "v1", "item_id", 10, 90).select("item_id", "text")
