"""Dead code: functions nothing reaches and nothing outside enters, with the reason for each."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomgraph.functions.paths import frameworks_of

#: File names, and parts of names, by which functions are entered from outside.
BARREL_FILES = ("index.ts", "index.js", "index.tsx", "index.jsx", "index.mts", "index.mjs", "mod.rs", "lib.rs", "__init__.py", "package-info.java", "GlobalUsings.cs", "AssemblyInfo.cs")
ENTRYPOINT_FILES = (
    "main.ts", "main.rs", "main.js", "main.tsx", "app.ts", "app.js", "app.tsx", "server.ts", "server.js", "main.py", "app.py", "manage.py",
    "Main.java", "Application.java", "App.java", "Program.cs", "Startup.cs", "App.cs",
)
HANDLER_SUFFIXES = (
    "handler", "controller", "middleware", "route", "resolver", "loader", "action", "endpoint", "servlet", "listener", "subscriber",
    "consumer", "producer", "interceptor", "guard", "pipe", "filter", "decorator",
)
HANDLER_PREFIXES = ("handle", "on_", "do_", "process_")
LIFECYCLE_NAMES = (
    "constructor", "init", "initialize", "setup", "teardown", "mount", "unmount", "dispose", "destroy", "finalize", "componentDidMount",
    "componentWillUnmount", "componentDidUpdate", "componentDidCatch", "getDerivedStateFromProps", "getSnapshotBeforeUpdate",
    "shouldComponentUpdate", "ngOnInit", "ngOnDestroy", "ngOnChanges", "ngAfterViewInit", "ngAfterContentInit", "created", "mounted",
    "beforeDestroy", "destroyed", "beforeMount", "beforeUpdate", "updated", "drop", "new", "default", "from", "try_from", "into",
    "__init__", "__del__", "__new__", "__enter__", "__exit__", "__call__", "__repr__", "__str__", "__bool__", "__len__", "__iter__",
    "__next__", "__getitem__", "__setitem__", "__delitem__", "__contains__", "__eq__", "__ne__", "__lt__", "__le__", "__gt__", "__ge__",
    "__hash__", "__getattr__", "__setattr__", "__delattr__", "__get__", "__set__", "__delete__", "__getstate__", "__setstate__",
    "__reduce__", "__reduce_ex__", "__nonzero__", "__format__", "__bytes__", "__complex__", "__int__", "__float__", "__index__", "__add__",
    "__sub__", "__mul__", "__truediv__", "__floordiv__", "__mod__", "__pow__", "__and__", "__or__", "__xor__", "__lshift__", "__rshift__",
    "__neg__", "__pos__", "__abs__", "__invert__", "__iadd__", "__isub__", "__imul__", "__radd__", "__rsub__", "__rmul__", "__missing__",
    "__copy__", "__deepcopy__", "__sizeof__", "__class_getitem__", "__init_subclass__", "__instancecheck__", "__subclasscheck__",
    "__subclasshook__", "__set_name__", "__mro_entries__", "__post_init__", "__aenter__", "__aexit__", "__aiter__", "__anext__",
    "__await__", "Awake", "Start", "Update", "FixedUpdate", "LateUpdate", "OnEnable", "OnDisable", "OnDestroy", "OnApplicationQuit",
    "OnCollisionEnter", "OnTriggerEnter", "ConfigureServices", "Configure", "Main", "Dispose", "ServeHTTP", "String", "Error", "Close",
    "Read", "Write", "MarshalJSON", "UnmarshalJSON",
)
JSX_RUNTIME_NAMES = ("jsx", "jsxs", "jsxDEV", "jsxAttr", "jsxEscape", "Fragment", "createElement", "createRef", "h")
ACCESSOR_NAMES = (
    "url", "method", "protocol", "readyState", "hostname", "port", "pathname", "search", "hash", "href", "origin", "host", "body", "headers",
    "status", "statusText", "type", "length", "size", "name", "value", "checked", "disabled", "selected",
)
PRIVATE = ("private", "fileprivate", "module_private")
REASONS = (
    "no_callers", "framework_annotation_unresolved", "declarative_wiring_unparsed", "dynamic_dispatch_target", "callback_target_not_tracked", "test_only_reference", "visibility_private_unused", "unclassified",
)
#: Methods that a view class's dispatch and a command runner call.
VIEW_METHODS = (
    "get", "post", "put", "patch", "delete", "head", "options", "trace", "get_queryset", "get_object", "get_context_data", "form_valid",
    "form_invalid", "get_success_url",
)
COMMAND_METHODS = ("handle", "add_arguments")


@dataclass(frozen=True)
class EntryRules:
    """Which rules of entry hold; the defaults are those of an unknown ecosystem."""

    jsx: bool = True
    property_accessors: bool = True
    mock_functions: bool = True
    trait_impls: bool = False
    exported_symbols: bool = True
    extra_patterns: tuple[str, ...] = field(default=())


def _ends(c: Column, words: tuple[str, ...]) -> Column:
    return c.rlike("(" + "|".join(words) + ")$")


def entry_reason(rules: EntryRules = EntryRules()) -> Column:
    """Why a function is entered from outside, by the first rule that holds; null if none does.

    Reads name, fqn, visibility and the flags of graph_nodes, and class_test, class_vendor, class_build, class_generated, class_path of the classifying file.
    """
    name, fqn = F.col("name"), F.col("fqn")
    low, fqn_low = F.lower(name), F.lower(fqn)
    file_name = F.element_at(F.split(F.coalesce("class_path", F.lit("")), "/"), -1)
    accessor = F.when(name.isin(*ACCESSOR_NAMES), fqn.contains("::")).otherwise(fqn.contains("::") & (F.length(name) <= 20) & _ends(low, ("path", "routes", "router")))
    intrinsic = fqn_low.contains("intrinsic_element::components::") | fqn_low.contains("intrinsic-element::components::") | (fqn_low.contains("jsx::dom::") & fqn_low.contains("::components::"))
    chain = [
        ("parent_file_is_test", F.col("class_test")),
        ("parent_file_is_vendor", F.col("class_vendor")),
        ("parent_file_is_build_output", F.col("class_build")),
        ("parent_file_is_generated", F.col("class_generated")),
        ("barrel_file", file_name.isin(*BARREL_FILES)),
        ("entrypoint_file", F.col("class_path").isNotNull() & (file_name.isin(*ENTRYPOINT_FILES) | (name == "main"))),
        ("framework_handler_convention", _ends(low, HANDLER_SUFFIXES) | _ends(fqn_low, HANDLER_SUFFIXES) | low.rlike("^(" + "|".join(HANDLER_PREFIXES) + ")")),
        ("lifecycle_method", name.isin(*LIFECYCLE_NAMES)),
    ]
    if rules.jsx:
        chain += [("jsx_component", name.rlike("^[A-Z][A-Za-z]")), ("jsx_runtime", name.isin(*JSX_RUNTIME_NAMES))]
    if rules.property_accessors:
        chain.append(("property_accessor", accessor))
    if rules.jsx:
        chain.append(("jsx_intrinsic_element", intrinsic))
    if rules.mock_functions:
        chain.append(("mock_function", low.rlike("^(mock|stub|fake)")))
    if rules.trait_impls:
        chain.append(("trait_impl", F.col("is_trait_impl")))
    chain += [("attribute_invoked", F.col("is_attribute_invoked")), ("callback_target", F.col("is_callback_target"))]
    if rules.exported_symbols:
        chain.append(("exported_symbol", F.col("visibility").isin("public", "exported", "pub_crate")))
    chain += [("extra_pattern_match", name.rlike(f"(?i){p}") | fqn.rlike(f"(?i){p}")) for p in rules.extra_patterns]
    out = F.when(F.coalesce(chain[0][1], F.lit(False)), chain[0][0])
    for reason, test in chain[1:]:
        out = out.when(F.coalesce(test, F.lit(False)), reason)
    return out


def with_class(functions: DataFrame, nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """functions with the flags and path of their classifying files; classes(id, class_id)."""
    files = nodes.select(
        F.col("id").alias("class_id"), F.col("is_test").alias("class_test"), F.col("is_vendor").alias("class_vendor"), F.col("is_build_output").alias("class_build"), F.col("is_generated").alias("class_generated"),
        F.coalesce("path_repo_rel", "file", F.lit("")).alias("class_path"),
    )
    return functions.join(classes, "id").join(files, "class_id", "left").drop("class_id")


def entry_points(functions: DataFrame, nodes: DataFrame, classes: DataFrame, rules: EntryRules = EntryRules()) -> DataFrame:
    """(id, reason) of the functions that are entered from outside."""
    return with_class(functions, nodes, classes).select("id", entry_reason(rules).alias("reason")).filter("reason is not null")


def framework_reason() -> Column:
    """The reason that the first of a function's frameworks gives, in their order; null if none gives one. Without frameworks of its own, those count that its file's name tells.

    Reads frameworks, language, name and class_path; callers are known to be none.
    """
    path, name = F.coalesce("class_path", F.lit("")), F.col("name")
    views, urls = path.endswith("/views.py") | path.contains("/views/"), path.endswith("urls.py")
    wired = (path.contains("/management/commands/") & name.isin(*COMMAND_METHODS)) | views | urls
    given = {
        "celery": F.when(path.endswith("/tasks.py") | path.contains("/tasks/"), "framework_annotation_unresolved"),
        "django": F.when(wired, "declarative_wiring_unparsed"),
        "jest": F.lit("framework_annotation_unresolved"),
        "vitest": F.lit("framework_annotation_unresolved"),
    }
    one = lambda f: F.coalesce(*[F.when(f == k, v) for k, v in given.items()])
    return F.get(F.filter(F.transform(F.when(F.size("frameworks") > 0, F.col("frameworks")).otherwise(frameworks_of(path, "language")), one), lambda r: r.isNotNull()), F.lit(0))


def dead_code(functions: DataFrame, nodes: DataFrame, classes: DataFrame, fans: DataFrame, outside: DataFrame, rules: EntryRules = EntryRules()) -> DataFrame:
    """(id, bucket, reason): functions without structural callers that are no entry points.

    bucket is production, test or vendor, by outside(id, is_non_production, in_test_file). reason is given by the rules for all, then by the function's
    frameworks, then by its visibility.
    """
    uncalled = with_class(functions, nodes, classes).join(fans.filter("fan_in = 0").select("id"), "id", "left_semi").filter(entry_reason(rules).isNull())
    reason = (
        F.when((F.size("entry_points") > 0) | F.col("is_attribute_invoked"), "framework_annotation_unresolved")
        .when(F.col("is_callback_target"), "callback_target_not_tracked")
        .when(F.coalesce("class_test", F.lit(False)), "test_only_reference")
        .when(framework_reason().isNotNull(), framework_reason())
        .when(F.col("visibility").isin(*PRIVATE), "visibility_private_unused")
        .otherwise("no_callers")
    )
    bucket = F.when(~F.col("is_non_production"), "production").when(F.col("in_test_file"), "test").otherwise("vendor")
    return uncalled.join(outside.select("id", "is_non_production", "in_test_file"), "id").select("id", bucket.alias("bucket"), reason.alias("reason"))


def reason_breakdown(dead: DataFrame) -> DataFrame:
    """(bucket, reason, n) of every bucket and reason, 0 where there are none."""
    spark = dead.sparkSession
    every = spark.createDataFrame([(b, r) for b in ("production", "test", "vendor") for r in REASONS], "bucket string, reason string")
    counts = dead.groupBy("bucket", "reason").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(every).join(counts, ["bucket", "reason"], "left").na.fill(0, ["n"])
