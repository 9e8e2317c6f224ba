"""Fixed values that results depend on, in their natural order: keywords, rule names, metric names, kinds of build failures."""

BUG_KEYWORDS = ("fix", "bug", "repair", "issue", "error")

#: Topics of quality and their keywords.
QUALITY_KEYWORDS = {
    "generic": (
        "obsolete", "renamed", "cleaning", "cleanup", "clean up", "cleaned up", "cleanups", "unused", "deprecated", "unnecessary",
        "refactoring", "refactor", "formatting", "generics", "simplify", "unnecessarily", "non necessary", "removal", "removed", "imports",
        "improve", "remove old", "refinements",
    ),
    "asat": (
        "error-prone", "infer", "pmd", "findbugs", "spotbugs", "checkstyle", "sonarcube",
    ),
    "factor": (
        "readability", "maintainability", "complexity",
    ),
    "pantiuchina": (
        "readability", "cohesion", "complexity", "coupling",
    ),
}

#: Warnings that a build reports by default.
DEFAULT_RULES = (
    "AvoidUsingHardCodedIP", "CheckResultSet", "UnusedFormalParameter", "UnusedLocalVariable", "UnusedPrivateField", "UnusedPrivateMethod",
    "DontImportJavaLang", "DuplicateImports", "ExtendsObject", "ForLoopShouldBeWhileLoop", "TooManyStaticImports",
    "UnnecessaryFullyQualifiedName", "UnnecessaryModifier", "UnnecessaryReturn", "UselessParentheses", "UselessQualifiedThis",
    "CollapsibleIfStatements", "SimplifiedTernary", "UselessOverridingMethod", "AvoidBranchingStatementAsLastInLoop",
    "AvoidDecimalLiteralsInBigDecimalConstructor", "AvoidMultipleUnaryOperators", "AvoidUsingOctalValues", "BrokenNullCheck",
    "CheckSkipResult", "ClassCastExceptionWithToArray", "DontUseFloatTypeForLoopIndices", "EmptyCatchBlock", "EmptyFinallyBlock",
    "EmptyIfStmt", "EmptyInitializer", "EmptyStatementBlock", "EmptyStatementNotInLoop", "EmptySwitchStatements", "EmptySynchronizedBlock",
    "EmptyTryBlock", "EmptyWhileStmt", "ImportFromSamePackage", "JumbledIncrementer", "MisplacedNullCheck",
    "OverrideBothEqualsAndHashcode", "ReturnFromFinallyBlock", "UnconditionalIfStatement", "UnnecessaryConversionTemporary",
    "UnusedNullCheckInEquals", "UselessOperationOnImmutable", "AvoidThreadGroup", "DontCallThreadRun", "DoubleCheckedLocking",
    "BigIntegerInstantiation", "BooleanInstantiation",
)

#: Categories of rules that a linter run checks, and the rules of them that it doesn't.
RULE_CATEGORIES = ("bestpractices", "codestyle", "design", "documentation", "errorprone", "multithreading", "performance", "security")
UNCHECKED_RULES = ("CommentSize", "DataflowAnomalyAnalysis")

#: Exit codes by which a linter says that it ran (with or without warnings), or that it failed.
RAN = {"pmd": (0, 4)}
FAILED = {"pylint": (32,)}

#: Static metrics of code entities.
STATIC_METRICS = (
    "PDA", "LOC", "CLOC", "PUA", "McCC", "LLOC", "LDC", "NOS", "MISM", "CCL", "TNOS", "TLLOC", "NLE", "CI", "HPL", "MI", "HPV", "CD",
    "NOI", "NUMPAR", "MISEI", "CC", "LLDC", "NII", "CCO", "CLC", "TCD", "NL", "TLOC", "CLLC", "TCLOC", "MIMS", "HDIF", "DLOC", "NLM",
    "DIT", "NPA", "TNLPM", "TNLA", "NLA", "AD", "TNLPA", "NM", "TNG", "NLPM", "TNM", "NOC", "NOD", "NOP", "NLS", "NG", "TNLG", "CBOI",
    "RFC", "NLG", "TNLS", "TNA", "NLPA", "NOA", "WMC", "NPM", "TNPM", "TNS", "NA", "LCOM5", "NS", "CBO", "TNLM", "TNPA",
)

#: How they are aggregated.
AGGREGATES = ("sum", "median", "max", "min", "avg")

#: Kinds of build failures and the words that show them.
BUILD_ERRORS = (
    ("version_missing", "dependencies.dependency.version"),
    ("plugin_missing", "Plugin not found in any plugin repository"),
    ("unique", "duplicate declaration of version"),
    ("parse", "Non-parseable POM"),
    ("parent", "Non-resolvable parent POM for"),
    ("malformed", "Malformed POM"),
    ("buildext", "Unresolvable build extension"),
    ("child", "Child module"),
    ("unknown_packaging", "Unknown packaging"),
)
