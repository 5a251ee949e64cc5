"""Which language a file is in, by its name, its first line or its content; column expressions and joins with a catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CATALOGUE_SCHEMA = "name string, type string, grammar string, extensions array<string>, filenames array<string>, interpreters array<string>"

# Common languages: name, type, grammar (null: none), extensions, file names, interpreters. A larger catalogue is a parameter.
COMMON = [
    ("Apex", "programming", None, ".cls .apex .trigger", "", ""),
    ("C", "programming", "c", ".c .h .idc", "", "tcc"),
    ("C#", "programming", "c_sharp", ".cs .csx .cake", "", ""),
    ("C++", "programming", "cpp", ".cpp .cc .cxx .hpp .hh .h .inl", "", ""),
    ("CMake", "programming", "cmake", ".cmake .cmake.in", "cmakelists.txt", ""),
    ("CSS", "markup", "css", ".css", "", ""),
    ("Dockerfile", "programming", "dockerfile", ".dockerfile .containerfile", "dockerfile containerfile", ""),
    ("Elixir", "programming", "elixir", ".ex .exs", "mix.lock", "elixir"),
    ("Erlang", "programming", "erlang", ".erl .es .hrl .app.src", "rebar.config", "escript"),
    ("F#", "programming", None, ".fs .fsi .fsx", "", ""),
    ("GLSL", "programming", "glsl", ".glsl .fs .vert .frag", "", ""),
    ("Go", "programming", "go", ".go", "", ""),
    ("Haskell", "programming", "haskell", ".hs .hs-boot", "", "runghc"),
    ("HTML", "markup", "html", ".html .htm .xht .html.hl", "", ""),
    ("Java", "programming", "java", ".java .jav", "", ""),
    ("JavaScript", "programming", "javascript", ".js .mjs .cjs .es .jsx", "jakefile", "node nodejs deno"),
    ("JSON", "data", "json", ".json .jsonl .geojson .webmanifest", ".all-contributorsrc composer.lock", ""),
    ("Kotlin", "programming", "kotlin", ".kt .kts", "", ""),
    ("Lua", "programming", "lua", ".lua .rockspec", ".luacheckrc", "lua luajit"),
    ("Makefile", "programming", "make", ".mk .mak .make", "makefile gnumakefile", "make"),
    ("MATLAB", "programming", "matlab", ".matlab .m", "", ""),
    ("Objective-C", "programming", "objc", ".m .h", "", ""),
    ("Perl", "programming", "perl", ".pl .pm .perl .t", "cpanfile", "perl cperl"),
    ("PHP", "programming", "php", ".php .phtml .inc", ".php_cs", "php"),
    ("Prolog", "programming", None, ".pl .pro .prolog", "", "swipl"),
    ("Python", "programming", "python", ".py .pyi .pyw .wsgi", "sconstruct", "python python2 python3"),
    ("R", "programming", "r", ".r .rd .rsx", ".rprofile", "rscript"),
    ("RenderScript", "programming", None, ".rs .rsh", "", ""),
    ("Ruby", "programming", "ruby", ".rb .rake .gemspec .ru", "gemfile rakefile vagrantfile", "ruby jruby"),
    ("Rust", "programming", "rust", ".rs .rs.in", "", "rust-script"),
    ("Scala", "programming", "scala", ".scala .sbt .sc", "", "scala"),
    ("Shell", "programming", "bash", ".sh .bash .zsh .bats", ".bashrc .profile pkgbuild", "bash sh zsh dash ksh"),
    ("SQL", "data", "sql", ".sql .ddl .prc", "", ""),
    ("Swift", "programming", "swift", ".swift", "", ""),
    ("TOML", "data", "toml", ".toml", "cargo.lock pipfile poetry.lock", ""),
    ("TypeScript", "programming", "typescript", ".ts .cts .mts", "", "ts-node bun"),
    ("Verilog", "programming", "systemverilog", ".v .veo", "", ""),
    ("V", "programming", None, ".v .vsh", "", ""),
    ("XML", "data", "xml", ".xml .xsd .svg .plist .ts .csproj", ".classpath", ""),
    ("YAML", "data", "yaml", ".yml .yaml .sublime-syntax", ".clang-format pixi.lock", ""),
]

# What an ambiguous extension is taken for, ids that don't follow from the name, extensions and names of prose.
PREFERRED = {
    ".h": "C", ".cls": "Apex", ".fs": "F#", ".json": "JSON", ".m": "Objective-C", ".php": "PHP", ".pl": "Perl",
    ".r": "R", ".rs": "Rust", ".sql": "SQL", ".v": "Verilog", ".yaml": "YAML", ".yml": "YAML",
}
IDS = {"C#": "csharp", "C++": "cpp", "Objective-C": "objective-c", "Shell": "bash"}
PROSE_EXTENSIONS = [".md", ".mdx", ".rst", ".txt", ".adoc", ".asciidoc"]
PROSE_NAMES = "readme|license|licence|changelog|contributing|authors|notice"
# Words that begin a declaration, may stand before it, or begin an import.
DECLARING = (
    "class interface enum struct record trait module namespace function fn func def method sub proc procedure type impl"
    " entity architecture package component"
).split()
BEFORE_DECLARING = "pub public private protected static async export abstract final open internal".split()
IMPORTING = "import include require use using from with".split()

#: White space of ECMAScript's \s, as the inside of a character class for Java and Python, without \n.
SPACE = "\\t\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
#: Lines of a file that are looked at for signs of code.
SIGN_LINES = 200


def declaration_pattern(space: str) -> str:
    return f"^{space}*(?:(?:{'|'.join(BEFORE_DECLARING)}){space}+)*+({'|'.join(DECLARING)}){space}+([A-Za-z_$][A-Za-z0-9_$.-]*)"


def import_pattern(space: str) -> str:
    return f"^{space}*(?:{'|'.join(IMPORTING)})\\b"


def catalogue(spark: SparkSession, rows: list[tuple] = COMMON) -> DataFrame:
    """The catalogue of rows like COMMON (extensions, names and interpreters as text between blanks), in their order."""
    return spark.createDataFrame([(*r[:3], *(x.split() for x in r[3:])) for r in rows], CATALOGUE_SCHEMA).coalesce(1)


def identifier(name: Column) -> Column:
    """Lower-case letters and digits between single hyphens; ++ reads pp, # reads sharp."""
    spelled = F.replace(F.replace(F.lower(name), F.lit("++"), F.lit("pp")), F.lit("#"), F.lit("sharp"))
    return F.regexp_replace(F.regexp_replace(spelled, "[^a-z0-9]+", "-"), "^-|-$", "")


def _best(known: DataFrame, column: str, key: str) -> DataFrame:
    """One language for each value of an array column: the preferred one, then with a grammar, then programming, then by name."""
    each = known.select("*", F.explode(F.transform(column, F.lower)).alias(key))
    wanted = F.element_at(F.create_map(*(F.lit(x) for kv in PREFERRED.items() for x in kv)), F.col(key))
    order = [F.coalesce(F.col("name") == wanted, F.lit(False)).desc(), F.col("grammar").isNotNull().desc(), (F.col("type") == "programming").desc(), F.col("name").asc()]
    if column == "interpreters":
        order = [F.col("_order").asc()]
    elif column == "filenames":
        order = order[1:]
    ranked = each.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1")
    return ranked.select(key, F.struct("name", "type", "grammar").alias(f"_{column}"))


def code_signs(text: Column) -> Column:
    """How many of four signs of code a text shows: a declaration or an import in its first lines, brackets with ; : or =, a first line #!/."""
    space = f"[{SPACE}]"
    head = F.slice(F.split(text, "\r?\n", SIGN_LINES + 1), 1, SIGN_LINES)
    shows = lambda pattern: F.exists(head, lambda line: line.rlike("(?i)" + pattern))
    brackets = text.rlike(r"^[^({]*+[({][^)}]*+[)}]") & text.rlike("[;:=]")
    first = text.rlike(f"^#![{SPACE}\\n]*/")
    return sum((c.cast("int") for c in (shows(import_pattern(space)), brackets, first)), shows(declaration_pattern(space)).cast("int"))


def detect_sources(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """files (path, text, any other columns) with language_id, language_name, language_type, grammar and detected_by.

    In this order: an extension of prose; names such as readme are known by content only; the file name; names that
    begin with dockerfile; the longest extension that the catalogue has; the interpreter of a first line #!, with
    ``/usr/bin/env`` or bare; two of the four ``code_signs``, whose language is the extension; else plain text. A null
    path or text counts as empty. The catalogue is joined on file name, interpreter and each run of extensions, as many
    as its longest has dots; these joins need no shuffle while it is small. Columns of these five names are replaced.
    """
    known = catalogue(files.sparkSession) if known is None else known
    known = known.withColumn("_order", F.monotonically_increasing_id())
    small = F.broadcast if known.limit(20_001).count() <= 20_000 else lambda df: df
    depth = known.select(F.explode("extensions").alias("e")).agg(F.max(F.size(F.split("e", "\\.")))).first()[0] or 1
    own = ["language_id", "language_name", "language_type", "grammar", "detected_by"]
    rows = files.select(F.struct("*").alias("_row"), F.coalesce("path", F.lit("")).alias("_path"), F.coalesce("text", F.lit("")).alias("_text"))
    name = F.substring_index("_path", "/", -1)
    rows = rows.withColumn("_base", F.lower(name))
    bang = F.regexp_extract("_text", f"^#!(?:[{SPACE}])*(?:/usr/bin/env[{SPACE}]+)?([^{SPACE}\\n/]+)(?:[{SPACE}\\n]|$)", 1)
    rows = rows.withColumn("_interpreter", F.lower(bang))
    named, run = _best(known, "filenames", "_base"), _best(known, "interpreters", "_interpreter")
    rows = rows.join(small(named), "_base", "left").join(small(run), "_interpreter", "left")
    suffixes = _best(known, "extensions", "_suffix")
    for k in range(depth - 1, 0, -1):  # .a.b before .b
        dotted = F.concat(F.lit("."), F.substring_index("_base", ".", -k))
        has = F.size(F.split("_base", "\\.")) > k
        rows = rows.withColumn("_suffix", F.when(has, dotted)).join(small(suffixes.withColumnRenamed("_extensions", f"_e{k}")), "_suffix", "left").drop("_suffix")
    extension = F.coalesce(*(F.col(f"_e{k}") for k in range(depth - 1, 0, -1))) if depth > 1 else F.lit(None).cast("struct<name string, type string, grammar string>")
    docker = known.where("name = 'Dockerfile'").select(F.struct("name", "type", "grammar").alias("_docker")).limit(1)
    rows = rows.join(F.broadcast(docker), how="left")  # one row
    prose = F.lower("_path").rlike("(" + "|".join(map(_quoted, PROSE_EXTENSIONS)) + ")$")
    unnamed = F.col("_base").rlike(f"^(?:{PROSE_NAMES})(?:\\.|$)")
    docker = F.when(F.col("_base").startswith("dockerfile"), F.col("_docker"))
    pick = F.struct  # the language and what told it
    none = F.lit(None).cast("struct<l struct<name string, type string, grammar string>, by string>")
    told = F.when(prose | unnamed, none)
    for language, by in ((F.col("_filenames"), "filename"), (docker, "filename"), (extension, "extension"), (F.col("_interpreters"), "shebang")):
        told = told.when(language.isNotNull(), pick(language.alias("l"), F.lit(by).alias("by")))
    # Signs are only looked for where nothing else told the language.
    coded = F.when(~prose & F.col("_told").isNull(), code_signs(F.col("_text")) >= 2).otherwise(F.lit(False))
    rows = rows.withColumn("_told", told.otherwise(none)).withColumn("_code", coded)
    last = F.when(name.contains("."), F.substring_index(name, ".", -1)).otherwise("source")
    guess = F.when(identifier(last) == "", "source").otherwise(identifier(last))
    l, is_known = F.col("_told.l"), F.col("_told").isNotNull()
    ids = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in IDS.items() for x in kv)), l["name"]), identifier(l["name"]))
    by_code = lambda a, b, c: F.when(is_known, a).when(F.col("_code"), b).otherwise(c)
    found = [
        by_code(ids, guess, F.lit("text")), by_code(l["name"], F.concat(F.lit("Unknown source ("), guess, F.lit(")")), F.lit("Plain text")),
        by_code(l["type"], F.lit("programming"), F.lit("text")), l["grammar"], by_code(F.col("_told.by"), F.lit("heuristic"), F.lit("plain-text")),
    ]
    rest = [F.col("_row")[c].alias(c) for c in files.columns if c not in own]
    return rows.select(*rest, *(c.alias(n) for c, n in zip(found, own, strict=True)))


def _quoted(extension: str) -> str:
    return extension.replace(".", "\\.")
