"""Data flows inside CI workflows: which step's Terraform output comes to which Helm value, and where a variable comes from.

Everything is keyed by the workflow, and steps by (workflow, job, position), so
that equal names in different workflows never meet. `frames` deals a workflow's
rows out once, to a bucket for each few MB of the input; the patterns work
within buckets and shuffle no steps again. A workflow with very many steps stays
linear, though in the task of its bucket: uses meet definitions by equal names,
and of the definers of a name only the first of each job, or the last of all,
are joined.

steps: (workflow, job, ordinal, position, step, text, uses, artifact, path, env)
with `ordinal` the place of the job in its workflow, `text` what the step runs,
`uses` its action, `artifact` and `path` what that action takes, `env` a map.
jobs: (workflow, job, ordinal, needs).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import checkpointed, kept_together, once, parts_of, together, wide
from .likeness import holding, of_few

# Base score of each pattern, in the order in which they are tried.
PATTERNS = {"direct_output": 90, "output_to_env": 80, "output_to_file": 75, "artifact_transfer": 65}
# Beginnings of variables that no output sets, and files that hold outputs.
OTHER_VARIABLES = ("GITHUB", "HOME", "PATH", "PWD", "USER")
OUTPUT_FILES = ("tf-output", "terraform-output", "outputs.json", ".tfoutput")
OUTPUT_PATHS = r"(?i)terraform.*output|tf.*output|\.tfoutput|outputs?\.json"
# Words of two names that go together, of a values file and a written file, and of two artifacts.
FILE_WORDS = (("terraform", "values"), ("tf", "helm"), ("output", "values"))
ARTIFACT_WORDS = ("terraform", "tf", "output")
# Names that look like outputs.
OUTPUT_NAMES = r"(?i)^tf_|_output$|^terraform_|cluster_endpoint|vpc_id|subnet_ids|security_group|arn$|rds_|eks_"

NAME = r"[a-zA-Z_][a-zA-Z0-9_]*"
SUBSTITUTED = rf"\$\(\s*terraform\s+output\s+(?:-raw\s+)?({NAME})\s*\)"


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _where(sure: Column, found: Column, kind: str = "array<string>") -> Column:
    """`found` where it can be anything, else an empty array: a literal of a pattern is sought faster than the pattern."""
    return F.when(sure, found.cast(kind)).otherwise(F.array().cast(kind))


def terraform_steps(steps: DataFrame) -> DataFrame:
    """The steps that run Terraform, with `outputs` (names that they ask for) and `command`; only those with outputs or that apply, plan or ask for outputs."""
    text = F.col("text")
    named = _where(F.contains(F.lower(text), F.lit("output")), _all(text, rf"(?i)terraform\s+output\s+(?:-(?:raw|json)\s+)?({NAME})"))
    captured = _where(F.contains(text, F.lit("=$(")), _all(text, rf"(?i){NAME}=\$\(\s*terraform\s+output\s+(?:-raw\s+)?({NAME})\s*\)"))
    command = F.lit("other")
    for kind in ("destroy", "show", "init", "plan", "apply", "output"):
        command = F.when(text.rlike(rf"(?i)terraform\s+{kind}"), kind).otherwise(command)
    found = F.struct(F.array_distinct(F.concat(named, captured)).alias("outputs"), command.alias("command"))
    good = lambda x: (F.size(x["outputs"]) > 0) | x["command"].isin("output", "apply", "plan")
    rows = steps.filter(text.rlike(r"(?i)terraform\s+")).select(*steps.columns, F.explode(F.filter(F.array(found), good)).alias("found"))  # the columns stay as they are, so that buckets hold
    return rows.select(*steps.columns, "found.outputs", "found.command")


def helm_steps(steps: DataFrame) -> DataFrame:
    """The steps that run Helm, with `set_values` (path, value; of one path the last) and `files` of values."""
    text = F.col("text")
    pairs = F.arrays_zip(*[_where(F.contains(text, F.lit("--set")), _all(text, r"--set(?:-string)?\s+([^=\s]+)=([^\s]+)", i)).alias(name) for i, name in ((1, "path"), (2, "value"))])
    last = once(pairs, lambda p: F.filter(p, lambda x, i: ~F.exists(F.slice(p, i + 2, F.size(p)), lambda y: y["path"] == x["path"])))
    files = F.concat(F.filter(_where(F.contains(text, F.lit("-f")), _all(text, r"-f\s+([^\s]+)")), lambda f: ~f.startswith("-")), _where(F.contains(text, F.lit("--values")), _all(text, r"--values[=\s]+([^\s]+)")))
    return steps.filter(text.rlike(r"(?i)helm\s+")).withColumns({"set_values": last, "files": files})


def frames(steps: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Steps that have a workflow, a job and a position, each once, the Terraform and the Helm steps among them, and the dependences of jobs; all written once, in equal buckets by workflow, as every pattern reads them."""
    place = ["workflow", "job", "position"]
    whole = steps.filter("workflow is not null and job is not null and position is not null")
    n = parts_of(whole, 4)
    whole = kept_together(whole, "workflow", "steps", n, place)
    direct = kept_together(_direct(jobs), "workflow", "needs", n, ["workflow", "job", "on"])
    with together(steps.sparkSession):
        return whole, kept_together(terraform_steps(whole), "workflow", "terraform"), kept_together(helm_steps(whole), "workflow", "helm"), kept_together(_closed(direct), "workflow", "needed", n)


def _direct(jobs: DataFrame) -> DataFrame:
    return jobs.select("workflow", "job", F.explode("needs").alias("on"))


def _closed(direct: DataFrame) -> DataFrame:
    after = direct.select("workflow", F.col("job").alias("on"), F.col("on").alias("next"))
    return direct.union(direct.join(after, ["workflow", "on"]).select("workflow", "job", F.col("next").alias("on"))).distinct()


def needed(jobs: DataFrame) -> DataFrame:
    """(workflow, job, on): what a job depends on, by itself or through one job between."""
    return _closed(wide(_direct(jobs).distinct()))


def _confidence(pattern: str, *strengths: Column) -> Column:
    """The pattern's base with three tenths of the mean strength and 2 for each piece of evidence, 10 at most; a null strength is no evidence."""
    n = sum((s.isNotNull().cast("int") for s in strengths), F.lit(0))
    total = sum((F.coalesce(s, F.lit(0)) for s in strengths), F.lit(0))
    return F.least(F.lit(100.0), F.round(F.lit(PATTERNS[pattern]) + total / n * 0.3 + F.least(n * 2, F.lit(10)))).cast("double")


def _with_dependence(found: DataFrame, depends: DataFrame) -> DataFrame:
    """`found` with `depends`: whether the target's job depends on the source's."""
    on = depends.select("workflow", F.col("job").alias("t_job"), F.col("on").alias("s_job"), F.lit(True).alias("depends"))
    return found.join(on, ["workflow", "t_job", "s_job"], "left").withColumn("depends", F.coalesce("depends", F.lit(False)))


def _flow(found: DataFrame, pattern: str, output: Column, path: Column, confidence: Column, seq: Column) -> DataFrame:
    return found.select("workflow", F.lit(pattern).alias("pattern"), F.col("s_job").alias("source_job"), F.col("s_position").alias("source_position"), output.alias("output"), F.col("t_job").alias("target_job"), F.col("t_position").alias("target_position"), path.alias("path"), confidence.alias("confidence"), F.struct(F.lit(list(PATTERNS).index(pattern)).alias("pattern"), "t_ordinal", "t_position", seq.alias("seq")).alias("order"))


def _written(pattern: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A pattern that joins within buckets and writes its flows."""

    @wraps(pattern)
    def run(*frames: DataFrame, **how) -> DataFrame:
        with together(frames[0].sparkSession):
            return checkpointed(pattern(*frames, **how), "flows")

    return run


def _target(helm: DataFrame, *more: Column) -> DataFrame:
    return helm.select("workflow", F.col("job").alias("t_job"), F.col("ordinal").alias("t_ordinal"), F.col("position").alias("t_position"), *more)


@_written
def direct_flows(terraform: DataFrame, helm: DataFrame, depends: DataFrame) -> DataFrame:
    """Flows of `--set path=$(terraform output x)`: from the first Terraform step that names x, in the same job if there is one, else in a job that this one depends on, else in any."""
    pattern = rf"--set(?:-string)?\s+([^=\s]+)={SUBSTITUTED}"
    pairs = F.arrays_zip(_all(F.col("text"), pattern, 1).alias("path"), _all(F.col("text"), pattern, 2).alias("output"))
    uses = _target(helm, F.posexplode(pairs).alias("seq", "x")).select("workflow", "t_job", "t_ordinal", "t_position", "seq", "x.path", "x.output")
    names = F.array_union(F.array_distinct(_all(F.col("text"), rf"({NAME})")), F.col("outputs"))
    first = terraform.select("workflow", "job", "ordinal", "position", F.explode(names).alias("output"))
    uses = kept_together(uses, "workflow", "uses")
    first = first.join(uses.select("workflow", "output").distinct(), ["workflow", "output"], "left_semi").groupBy("workflow", "output", "job").agg(F.min(F.struct("ordinal", "position", "job")).alias("at"))
    first = kept_together(first, "workflow", "first")
    asked = uses.select("workflow", "t_job", "output").distinct()
    same = first.select("workflow", "output", F.col("job").alias("t_job"), F.col("at").alias("same"))
    behind = asked.join(depends.select("workflow", F.col("job").alias("t_job"), F.col("on").alias("job")), ["workflow", "t_job"]).join(first, ["workflow", "output", "job"]).groupBy("workflow", "t_job", "output").agg(F.min("at").alias("behind"))
    anywhere = first.groupBy("workflow", "output").agg(F.min("at").alias("anywhere"))
    source = asked.join(same, ["workflow", "t_job", "output"], "left").join(behind, ["workflow", "t_job", "output"], "left").join(anywhere, ["workflow", "output"]).select("workflow", "t_job", "output", F.coalesce("same", "behind", "anywhere").alias("s"))
    found = uses.join(source, ["workflow", "t_job", "output"]).withColumns({"s_job": F.col("s.job"), "s_position": F.col("s.position")})
    return _flow(found, "direct_output", F.col("output"), F.col("path"), _confidence("direct_output", F.lit(95), F.lit(90)), F.col("seq"))


def definitions(terraform: DataFrame) -> DataFrame:
    """(workflow, variable, output, s_job, s_ordinal, s_position, seq): variables that Terraform steps set from outputs, by export or assignment, by a line for $GITHUB_ENV, or in their env."""
    text = F.col("text")
    assigned = rf"({NAME})={SUBSTITUTED}"
    plain = F.arrays_zip(_all(text, assigned, 1).alias("variable"), _all(text, assigned, 2).alias("output"))
    line = rf"echo\s+[\"']?({NAME})=([^\"'\n]+)[\"']?\s*>>\s*\$GITHUB_ENV"
    lines = F.arrays_zip(_all(text, line, 1).alias("variable"), _all(text, line, 2).alias("value"))
    asked = lambda value: F.nullif(F.regexp_extract(value, SUBSTITUTED, 1), F.lit(""))
    held = lambda value: F.try_element_at(F.filter("outputs", lambda o: F.contains(value, o)), F.lit(1))
    written = F.filter(F.transform(lines, lambda x: F.struct(x["variable"].alias("variable"), F.coalesce(asked(x["value"]), held(x["value"])).alias("output"))), lambda x: x["output"].isNotNull())
    from_env = F.filter(F.map_entries(F.coalesce("env", F.create_map().cast("map<string,string>"))), lambda e: e["value"].rlike(r"\$\(\s*terraform\s+output|needs\.[^.]+\.outputs\."))
    own = F.when(F.size("outputs") > 0, F.transform(from_env, lambda e: F.struct(e["key"].alias("variable"), F.col("outputs")[0].alias("output"))))
    kind = "array<struct<variable:string,output:string>>"
    every = F.concat(_where(F.contains(text, F.lit("=$(")), plain, kind), _where(F.contains(text, F.lit("GITHUB_ENV")), written, kind), F.coalesce(own.cast(kind), F.array().cast(kind)))
    rows = terraform.select("workflow", F.col("job").alias("s_job"), F.col("ordinal").alias("s_ordinal"), F.col("position").alias("s_position"), F.posexplode(every).alias("seq", "x"))
    return rows.select("workflow", "x.variable", "x.output", "s_job", "s_ordinal", "s_position", "seq")


def uses_of_variables(helm: DataFrame) -> DataFrame:
    """(workflow, t_job, t_ordinal, t_position, variable, path, seq): variables that Helm steps set values from: those in a `--set` value, and those that stand anywhere behind a `--set` in its line."""
    shell, action = rf"\$\{{?({NAME})\}}?", rf"\$\{{\{{\s*env\.({NAME})\s*\}}\}}"
    other = lambda v: ~F.exists(F.array(*map(F.lit, OTHER_VARIABLES)), lambda p: F.startswith(v, p))
    kind = "array<struct<variable:string,path:string>>"
    from_values = F.flatten(F.transform(F.filter("set_values", lambda s: F.contains(s["value"], F.lit("$"))), lambda s: F.transform(F.filter(F.array_distinct(_all(s["value"], shell)), other), lambda v: F.struct(v.alias("variable"), s["path"].alias("path"))))).cast(kind)
    after = lambda v, form: F.nullif(F.call_function("regexp_extract", F.col("text"), F.concat(F.lit(r"--set(?:-string)?\s+([^=\s]+)=.*"), *form(v)), F.lit(1)), F.lit(""))
    as_shell = lambda v: (F.lit(r"\$\{?"), v, F.lit(r"\}?"))
    as_action = lambda v: (F.lit(r"\$\{\{\s*env\."), v, F.lit(r"\s*\}\}"))
    behind = F.transform(F.filter(F.array_distinct(_all(F.col("text"), shell)), other), lambda v: F.struct(v.alias("variable"), after(v, as_shell).alias("path"))).cast(kind)
    named = F.transform(F.array_distinct(_all(F.col("text"), action)), lambda v: F.struct(v.alias("variable"), after(v, as_action).alias("path"))).cast(kind)
    every = F.array_distinct(F.filter(F.concat(from_values, _where(F.contains("text", F.lit("$")), behind, kind), _where(F.contains("text", F.lit("env.")), named, kind)), lambda x: x["path"].isNotNull()))
    return _target(helm, F.posexplode(every).alias("seq", "x")).select("workflow", "t_job", "t_ordinal", "t_position", "x.variable", "x.path", "seq")


@_written
def env_flows(terraform: DataFrame, helm: DataFrame, depends: DataFrame, reaching: bool = False) -> DataFrame:
    """Flows through variables. A variable has the workflow's last definition; with `reaching`, the last one that stands before its use."""
    set_by, uses = definitions(terraform), uses_of_variables(helm)
    value = F.struct("output", "s_job", "s_position")
    if reaching:
        at = lambda side: F.struct(F.col(f"{side}_ordinal").alias("ordinal"), F.col(f"{side}_position").alias("position"), F.lit(int(side == "s")).alias("late"), F.col("seq").alias("seq"))
        none = F.lit(None)
        first = set_by.select("workflow", "variable", at("s").alias("at"), value.alias("d"), none.cast("string").alias("t_job"), none.cast("int").alias("t_ordinal"), none.cast("int").alias("t_position"), none.cast("string").alias("path"), none.cast("int").alias("seq"))
        second = uses.select("workflow", "variable", at("t").alias("at"), none.cast(set_by.select(value.alias("d")).schema["d"].dataType).alias("d"), "t_job", F.col("t_ordinal").cast("int").alias("t_ordinal"), F.col("t_position").cast("int").alias("t_position"), "path", "seq")
        line = Window.partitionBy("workflow", "variable").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = first.union(second).withColumn("d", F.last("d", True).over(line)).filter("t_job is not null and d is not null")
    else:
        last = set_by.groupBy("workflow", "variable").agg(F.max_by(value, F.struct("s_ordinal", "s_position", "seq")).alias("d"))
        found = uses.join(last, ["workflow", "variable"])
    found = _with_dependence(found.select("*", "d.output", "d.s_job", "d.s_position"), depends)
    return _flow(found, "output_to_env", F.col("output"), F.col("path"), _confidence("output_to_env", F.lit(80), F.lit(75), F.when(F.col("depends") & (F.col("s_job") != F.col("t_job")), 70)), F.col("seq"))


def _base(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]+$", "")


def _files_of_many(asked: DataFrame, written: DataFrame, ends: Column) -> DataFrame:
    """(workflow, file, piped, at): read and written files that match, of workflows with so many that they meet by keys of their names."""

    def near(mine: str, theirs: str) -> DataFrame:
        """(workflow, file, other): of one's name holds the other's."""
        name = lambda df, column: df.select("workflow", F.col(column).alias("name")).distinct()
        met = holding(name(asked, mine), name(written, theirs), ["workflow"])
        left, right = asked.select("workflow", "file", F.col(mine).alias("left")).distinct(), written.select("workflow", "other", F.col(theirs).alias("right"))
        return left.join(met, ["workflow", "left"]).join(right, ["workflow", "right"]).select("workflow", "file", "other")

    plain = asked.filter(~F.col("piped"))
    pairs = near("file", "other").join(asked, ["workflow", "file"]).filter(~F.col("piped") | ends).select("workflow", "file", "piped", "other")
    pairs = pairs.union(near("base", "other_base").join(plain, ["workflow", "file"]).select("workflow", "file", "piped", "other"))
    found = pairs.join(written, ["workflow", "other"]).select("workflow", "file", "piped", "at")
    for mine, theirs in FILE_WORDS:  # the first written file with the one word, for each values file with the other
        first = written.filter(F.contains("other_base", F.lit(theirs))).groupBy("workflow").agg(F.min("at").alias("at"))
        found = found.union(plain.filter(F.contains("base", F.lit(mine))).join(first, "workflow").select("workflow", "file", "piped", "at"))
    return found


@_written
def file_flows(terraform: DataFrame, helm: DataFrame, depends: DataFrame) -> DataFrame:
    """Flows through files that Terraform steps write their outputs to: jq or yq reads such a file for Helm, or a values file is like it in name. Of the written files that match the first counts."""
    text = F.col("text")
    files = F.concat(_all(text, r"terraform\s+output\s+-json\s*(?:>\s*|>>?\s*)([^\s|;]+)"), _all(text, r"terraform\s+output\s+-json\s*\|\s*tee\s+([^\s|;]+)"))
    written = terraform.select("workflow", "job", "ordinal", "position", F.posexplode(files).alias("seq", "file"))
    written = written.groupBy("workflow", "file").agg(F.min(F.struct("ordinal", "position", "seq", "job")).alias("at"))
    written = kept_together(written.select("workflow", F.col("file").alias("other"), _base(F.col("file")).alias("other_base"), "at"), "workflow", "written")
    read = r"-f\s+<\(\s*(jq|yq)\s+['\"]([^'\"]*)['\"]\s+([^\s)]+)\s*\)"
    shape = _all(text, read, 2)
    key = lambda t: F.coalesce(F.nullif(F.regexp_extract(t, rf"\{{({NAME}):", 1), F.lit("")), F.nullif(F.regexp_extract(t, rf"\.({NAME})", 1), F.lit("")), F.lit("values"))
    pipes = F.transform(F.arrays_zip(_all(text, read, 3).alias("file"), shape.alias("shape")), lambda x: F.struct(x["file"].alias("file"), key(x["shape"]).alias("path"), F.lit(True).alias("piped")))
    named = F.transform("files", lambda f: F.struct(f.alias("file"), f.alias("path"), F.lit(False).alias("piped")))
    kind = "array<struct<file:string,path:string,piped:boolean>>"
    uses = _target(helm, F.posexplode(F.concat(pipes.cast(kind), named.cast(kind))).alias("seq", "x")).select("workflow", "t_job", "t_ordinal", "t_position", "seq", "x.*")
    uses = kept_together(uses.withColumn("base", _base(F.col("file"))), "workflow", "uses")
    asked = uses.select("workflow", "file", "base", "piped").distinct()
    sizes, others = of_few(asked, written, ["workflow"])
    key = ["workflow", "file", "piped"]
    first = lambda df: df.groupBy(*key).agg(F.min("at").alias("s"))
    some = asked.join(sizes.filter("few").select("workflow"), "workflow", "left_semi") if others else asked
    ends = F.endswith("file", "other") | F.endswith("other", "file")
    holds = F.contains("file", "other") | F.contains("other", "file") | F.contains("base", "other_base") | F.contains("other_base", "base")
    go_together = [F.contains("base", F.lit(mine)) & F.contains("other_base", F.lit(theirs)) for mine, theirs in FILE_WORDS]
    found = first(some.join(written, "workflow").filter(F.when(F.col("piped"), ends).otherwise(reduce(or_, go_together, holds))))
    if others:
        large = lambda df: df.join(sizes.filter("not few").select("workflow"), "workflow", "left_semi")
        found = found.union(first(_files_of_many(large(asked), large(written), ends)))
    found = _with_dependence(uses.join(found, ["workflow", "file", "piped"]).withColumns({"s_job": F.col("s.job"), "s_position": F.col("s.position")}), depends)
    piped = _confidence("output_to_file", F.lit(85), F.lit(80), F.when(F.col("depends") & (F.col("s_job") != F.col("t_job")), 75))
    return _flow(found, "output_to_file", F.lit("json_outputs"), F.col("path"), F.when(F.col("piped"), piped).otherwise(_confidence("output_to_file", F.lit(60))), F.col("seq"))


@_written
def artifact_flows(steps: DataFrame, terraform: DataFrame, helm: DataFrame, depends: DataFrame) -> DataFrame:
    """Flows through artifacts: an upload in a job with Terraform steps, the first that the name of a download in the Helm step's job matches, if the Helm step uses its file."""
    first = terraform.groupBy("workflow", "job").agg(F.min("position").alias("s_position"), F.min_by("ordinal", "position").alias("s_ordinal"))
    acts = lambda kind: steps.filter(F.contains(F.coalesce("uses", F.lit("")), F.lit(kind))).select("workflow", "job", "position", F.lower(F.coalesce("artifact", F.lit("artifact"))).alias("name"), F.coalesce("path", F.lit("")).alias("path"))
    ups = acts("upload-artifact").join(first, ["workflow", "job"])
    said = ups.select("workflow", "job", "path").distinct().join(terraform.select("workflow", "job", "text"), ["workflow", "job"]).filter(F.contains("text", "path")).select("workflow", "job", "path", F.lit(True).alias("said")).distinct()
    ups = ups.join(said, ["workflow", "job", "path"], "left").withColumn("with_output", F.coalesce("said", F.lit(False)) | F.col("path").rlike(OUTPUT_PATHS))
    ups = kept_together(ups.groupBy("workflow", "name").agg(F.min(F.struct("s_ordinal", "position", "job", "s_position", "path", "with_output")).alias("at")), "workflow", "uploads")
    downs = acts("download-artifact").select("workflow", F.col("job").alias("t_job"), F.col("position").alias("seq"), "name", F.col("path").alias("d_path"))
    asked = downs.select("workflow", "name").distinct()
    pairs = holding(asked, ups, ["workflow"]).select("workflow", F.col("left").alias("name"), F.col("right").alias("other"))
    found = pairs.join(ups.withColumnRenamed("name", "other"), ["workflow", "other"]).select("workflow", "name", "at")
    for word in ARTIFACT_WORDS:
        one = ups.filter(F.contains("name", F.lit(word))).groupBy("workflow").agg(F.min("at").alias("at"))
        found = found.union(asked.filter(F.contains("name", F.lit(word))).join(one, "workflow").select("workflow", "name", "at"))
    found = downs.join(found.groupBy("workflow", "name").agg(F.min("at").alias("s")), ["workflow", "name"])
    met = _target(helm, F.col("text"), F.col("files")).join(found, ["workflow", "t_job"]).withColumns({"s_job": F.col("s.job"), "s_position": F.col("s.s_position"), "u_path": F.col("s.path")})
    file = F.when(F.col("d_path") != "", F.col("d_path")).otherwise(F.col("u_path"))
    marks = [F.contains("text", F.lit(p)) & F.contains("u_path", F.lit(p)) for p in OUTPUT_FILES]
    used = F.contains("text", file) | F.exists("files", lambda v: F.endswith(v, file) | F.endswith(file, v)) | marks[0] | marks[1] | marks[2] | marks[3]
    met = _with_dependence(met.filter(used), depends)
    with_output = F.col("s.with_output")
    output = F.when(with_output, F.coalesce(F.nullif(_base(F.col("u_path")), F.lit("")), F.lit("outputs"))).otherwise("artifact_data")
    return _flow(met, "artifact_transfer", output, F.when(F.col("d_path") != "", F.col("d_path")).otherwise("values"), _confidence("artifact_transfer", F.lit(75), F.lit(75), F.when(F.col("depends"), 85), F.when(with_output, 80)), F.col("seq"))


def detected(steps: DataFrame, jobs: DataFrame, least: float = 0, most: int | None = None, reaching: bool = False) -> DataFrame:
    """(workflow, pattern, source_job, source_position, output, target_job, target_position, path, confidence): flows from Terraform outputs to Helm values by all patterns.

    Of one (source job, output, target job, path) the first counts, in the
    order of the patterns and of the Helm steps. With `most`, the surest flows
    of each workflow. Rows without a workflow or a job give nothing; repeated
    steps count once; steps without text only carry artifacts. An output is
    named by a Terraform step if it is one of the names in its text.
    """
    steps, terraform, helm, depends = frames(steps, jobs)
    found = direct_flows(terraform, helm, depends).union(env_flows(terraform, helm, depends, reaching=reaching)).union(file_flows(terraform, helm, depends)).union(artifact_flows(steps, terraform, helm, depends))
    key = ["workflow", "source_job", "output", "target_job", "path"]
    chosen = F.min(F.struct("order", "pattern", "source_position", "target_position", "confidence")).alias("b")
    found = found.groupBy(*key).agg(chosen).select("workflow", "b.pattern", "source_job", "b.source_position", "output", "target_job", "b.target_position", "path", "b.confidence", "b.order").filter(F.col("confidence") >= least)
    if most is not None:
        line = Window.partitionBy("workflow").orderBy(F.desc("confidence"), "order", "source_job", "output", "path")
        found = found.withColumn("n", F.row_number().over(line)).filter(F.col("n") <= most).drop("n")
    return found.drop("order")


def job_chains(found: DataFrame, jobs: DataFrame, longest: int = 20) -> DataFrame:
    """(workflow, source, target, chain): the shortest ways from source jobs to target jobs of `found` (workflow, source_job, target_job) along `needs`, ties in the order of names; without a way both ends alone."""
    pairs = wide(checkpointed(found.select("workflow", F.col("source_job").alias("source"), F.col("target_job").alias("target")).distinct(), "pairs"))
    moves = wide(checkpointed(jobs.select("workflow", F.col("job").alias("there"), F.explode("needs").alias("here")).distinct(), "moves"))
    frontier = pairs.select("workflow", "source").distinct().select("workflow", "source", F.col("source").alias("at"), F.array("source").alias("chain"))
    seen = frontier
    for _ in range(longest):
        grown = frontier.join(moves, (frontier["workflow"] == moves["workflow"]) & (frontier["at"] == moves["here"])).select(frontier["workflow"], "source", F.col("there").alias("at"), F.concat("chain", F.array("there")).alias("chain"))
        grown = grown.groupBy("workflow", "source", "at").agg(F.min("chain").alias("chain")).join(wide(seen.select("workflow", "source", "at")), ["workflow", "source", "at"], "left_anti")
        frontier = wide(checkpointed(grown, "chains"))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    way = seen.select("workflow", "source", F.col("at").alias("target"), "chain")
    alone = F.when(F.col("source") == F.col("target"), F.array("source")).otherwise(F.array("source", "target"))
    return pairs.join(wide(way), ["workflow", "source", "target"], "left").select("workflow", "source", "target", F.coalesce("chain", alone).alias("chain"))


def traced(variables: DataFrame, steps: DataFrame, jobs: DataFrame) -> DataFrame:
    """(workflow, job, scope, name, type, source, confidence): where variables (workflow, job, scope, name) may come from.

    needs: jobs that the job needs (or the one that the name begins with) and
    that run Terraform, 85 with the output or any output asked for, else 60;
    75 for an output that the job declares from Terraform. env: the job's env,
    80 from Terraform or an output, else 40. steps: the job's step of that id,
    90. Other scopes go by the name alone, 45. `jobs` has (workflow, job,
    needs, env, outputs), maps from names to texts; both may be null.
    """
    terraform = checkpointed(terraform_steps(steps).select("workflow", "job", "outputs", "command"), "terraform")
    own = wide(checkpointed(variables.select("workflow", "job", "scope", "name").distinct(), "variables"))  # each scope reads it
    parts = F.split("name", r"\.")
    output = F.element_at(parts, -1)
    given = F.when(F.size(parts) >= 2, parts[0])
    needs = wide(jobs.select("workflow", "job", F.explode("needs").alias("on")).distinct())
    asks = own.filter("scope = 'needs'").withColumns({"output": output, "given": given}).join(needs, ["workflow", "job"]).filter(F.col("given").isNull() | (F.col("given") == F.col("on")))
    runs = terraform.groupBy("workflow", F.col("job").alias("on")).agg(F.bool_or(F.col("command") == "output").alias("asks_any"))
    names = terraform.select("workflow", F.col("job").alias("on"), F.explode("outputs").alias("output"), F.lit(True).alias("named")).distinct()
    hit = asks.join(runs, ["workflow", "on"]).join(names, ["workflow", "on", "output"], "left")
    known = F.col("asks_any") | F.coalesce("named", F.lit(False))
    source = F.concat("on", F.lit(".outputs."), "output")
    row = lambda df, kind, source, sure: df.select("workflow", "job", "scope", "name", kind.alias("type"), source.alias("source"), sure.cast("double").alias("confidence"))
    found = row(hit, F.when(known, "terraform_output").otherwise("job_output"), source, F.when(known, 85).otherwise(60))
    declared = jobs.filter("outputs is not null").select("workflow", F.col("job").alias("on"), F.explode("outputs").alias("output", "value")).filter(F.contains("value", F.lit("terraform")) | F.contains("value", F.lit("TF_")))
    told = own.filter("scope = 'needs'").withColumns({"output": output, "on": given}).join(declared, ["workflow", "on", "output"])
    found = found.union(row(told, F.lit("terraform_output"), source, F.lit(75)))
    env = jobs.filter("env is not null").select("workflow", "job", F.explode("env").alias("name", "value"))
    from_env = own.filter("scope = 'env'").join(env, ["workflow", "job", "name"])
    real = F.contains("value", F.lit("terraform output")) | (F.contains("value", F.lit("needs.")) & F.contains("value", F.lit("outputs")))
    found = found.union(row(from_env, F.when(real, "terraform_output").otherwise("env_variable"), F.concat(F.lit("env."), "name"), F.when(real, 80).otherwise(40)))
    ran = terraform_texts(steps).select("workflow", "job", "step", "outputs", F.contains("text", F.lit("terraform output")).alias("any"))
    of_step = own.filter("scope = 'steps'").withColumns({"step": parts[0], "output": output}).join(ran, ["workflow", "job", "step"]).filter(F.col("any") | F.array_contains("outputs", F.col("output")))
    found = found.union(row(of_step, F.lit("terraform_output"), F.concat(F.lit("steps."), "step", F.lit(".outputs."), "output"), F.lit(90)))
    by_name = own.filter(~F.col("scope").isin("needs", "env", "steps") & F.col("name").rlike(OUTPUT_NAMES))
    return found.union(row(by_name, F.lit("terraform_output"), F.col("name"), F.lit(45))).distinct()


def terraform_texts(steps: DataFrame) -> DataFrame:
    """All steps that name Terraform, with the outputs that they ask for."""
    named = _all(F.col("text"), rf"(?i)terraform\s+output\s+(?:-(?:raw|json)\s+)?({NAME})")
    return steps.filter(F.col("text").rlike(r"(?i)terraform\s+")).withColumn("outputs", F.array_distinct(named))


def output_flows(steps: DataFrame, jobs: DataFrame, least: float = 0) -> DataFrame:
    """(workflow, source_job, source_step, output, target_job, target_step, flow_type, confidence): outputs that expressions of steps name.

    `needs.J.outputs.O` comes from job J, `steps.S.outputs.O` from step S of the
    same job, at 95; and where J is needed and runs Terraform and the step runs
    Helm, also as terraform_to_helm at 85. A step without an id has its place.
    """
    text = F.col("text")
    expressions = F.array_join(_all(text, r"(?s)\$\{\{(.*?)\}\}"), " ; ")
    here = steps.filter(F.contains("text", F.lit("${{"))).select("workflow", F.col("job").alias("target_job"), F.coalesce("step", F.concat(F.lit("step-"), F.col("position").cast("string"))).alias("target_step"), text.rlike(r"(?i)helm\s+").alias("helm"), expressions.alias("e"))
    word = r"([A-Za-z_][\w-]*)"
    refs = lambda context: F.arrays_zip(_all(F.col("e"), rf"\b{context}\.{word}\.outputs\.{word}", 1).alias("source"), _all(F.col("e"), rf"\b{context}\.{word}\.outputs\.{word}", 2).alias("output"))
    rows = lambda context: here.select("workflow", "target_job", "target_step", "helm", F.explode(F.array_distinct(refs(context))).alias("x")).select("workflow", "target_job", "target_step", "helm", "x.source", "x.output")
    needs, own = rows("needs"), rows("steps")
    columns = ["workflow", "source_job", "source_step", "output", "target_job", "target_step", "flow_type", "confidence"]
    made = lambda df, job, step, kind, sure: df.select("workflow", job.alias("source_job"), step.alias("source_step"), "output", "target_job", "target_step", F.lit(kind).alias("flow_type"), F.lit(float(sure)).alias("confidence")).select(*columns)
    none = F.lit(None).cast("string")
    wanted = jobs.select("workflow", F.col("job").alias("target_job"), F.explode("needs").alias("source")).distinct()
    runs = terraform_texts(steps).select("workflow", F.col("job").alias("source")).distinct()
    cross = needs.filter("helm").join(wanted, ["workflow", "target_job", "source"], "left_semi").join(runs, ["workflow", "source"], "left_semi")
    found = made(needs, F.col("source"), none, "job_output", 95).union(made(own, F.col("target_job"), F.col("source"), "step_output", 95)).union(made(cross, F.col("source"), none, "terraform_to_helm", 85))
    return found.filter(F.col("confidence") >= least).distinct()


# Kinds of operations in the order in which they are tried, the commands that show them, and the actions that do.
_TERRAFORM = r"(init|plan|apply|destroy|output|validate|fmt|import|state|workspace|refresh)"
OPERATIONS = {
    "terraform": (rf"terraform\s+{_TERRAFORM}", rf"tofu\s+{_TERRAFORM}", r"terragrunt\s+(init|plan|apply|destroy|output|validate|run-all)"),
    "helm": (r"helm\s+(install|upgrade|uninstall|rollback|template|lint|package|push|pull|repo|dependency)", r"helmfile\s+(sync|apply|diff|template|destroy|repos)"),
    "kubectl": (r"kubectl\s+(apply|delete|create|get|describe|logs|exec|rollout|scale|patch)",),
    "docker": (r"docker\s+(build|push|pull|run|compose|login|tag)", r"docker-compose\s+(up|down|build|push|pull)", r"buildah\s+(build|bud|push|pull)", r"(kaniko)"),
}
ACTIONS = {
    "terraform": ("hashicorp/setup-terraform", "hashicorp/terraform-github-actions", "dflook/terraform-", "gruntwork-io/terragrunt-action"),
    "helm": ("azure/setup-helm", "azure/k8s-deploy", "deliverybot/helm", "helm/chart-releaser-action"),
}


def operations(steps: DataFrame) -> DataFrame:
    """(workflow, job, position, type, command, outputs): at most one operation of each step, of the first kind whose command it runs or whose action it uses, else a script. Steps that run nothing and use no known action have none."""
    text, uses = F.coalesce("text", F.lit("")), F.coalesce("uses", F.lit(""))
    command = lambda kind: F.coalesce(*[F.nullif(F.regexp_extract(text, f"(?i){p}", 1), F.lit("")) for p in OPERATIONS[kind]])
    acts = lambda kind: F.exists(F.array(*map(F.lit, ACTIONS[kind])), lambda a: F.contains(uses, a)) if kind in ACTIONS else F.lit(False)
    kind, said = F.when(F.length(F.trim(F.regexp_replace(text, r"\s+", " "))) > 0, "script"), F.coalesce("uses", F.lit("script"))
    for name in reversed(OPERATIONS):
        hit = command(name).isNotNull() | acts(name)
        other = "build" if name == "docker" else "unknown"
        own = F.coalesce(F.nullif(F.lower(command(name)), F.lit("kaniko")), F.lit(other))
        kind, said = F.when(hit, name).otherwise(kind), F.when(hit, own).otherwise(said)
    outputs = F.concat(_all(text, rf"(?i)terraform\s+output\s+(?:-raw\s+)?(?:-json\s+)?({NAME})"), _all(text, rf"echo\s+[\"']?({NAME})="))
    found = steps.select("workflow", "job", "position", kind.alias("type"), said.alias("command"), outputs.alias("outputs")).filter("type is not null")
    return found.withColumn("outputs", F.when(F.col("type") == "terraform", F.col("outputs")).otherwise(F.array().cast("array<string>")))
