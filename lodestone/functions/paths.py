"""Column functions over paths: kinds, languages, slugs and guards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions by kind of file, and names of generated files.
CODE = [
    ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".rb", ".go", ".rs", ".java", ".kt", ".swift",
    ".php", ".cs", ".c", ".h", ".cpp", ".hpp", ".cc", ".vue", ".svelte", ".scala", ".dart", ".lua", ".sh",
    ".bash", ".zsh",
]
CONFIG = [
    ".json", ".yaml", ".yml", ".toml", ".ini", ".env", ".conf", ".config", ".properties", ".editorconfig",
]
DOC = [
    ".md", ".markdown", ".rst", ".txt", ".adoc",
]
GENERATED = [
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "cargo.lock", "poetry.lock",
    "pipfile.lock", "composer.lock", "gemfile.lock",
]
BINARY = [
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".webp", ".avif", ".tiff", ".svgz", ".mp3", ".mp4",
    ".mov", ".avi", ".mkv", ".wav", ".flac", ".ogg", ".zip", ".tar", ".gz", ".bz2", ".xz", ".7z", ".rar",
    ".jar", ".war", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".odt", ".exe", ".dll", ".so",
    ".dylib", ".o", ".a", ".lib", ".class", ".pyc", ".pyo", ".wasm", ".bin", ".dat", ".db", ".sqlite",
    ".sqlite3", ".woff", ".woff2", ".ttf", ".otf", ".eot", ".psd", ".ai", ".sketch", ".blend", ".lockb",
    ".webm",
]
SUPPORTED = [
    ".pdf", ".md", ".markdown", ".txt",
]
# Skeleton families and fence languages by extension.
FAMILIES = {
    "typescript": [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".svelte"],
    "python": [".py"],
    "go": [".go"],
    "rust": [".rs"],
    "java": [".java", ".kt", ".scala"],
    "c": [".c", ".h", ".cpp", ".hpp", ".cc", ".cs"],
    "ruby": [".rb"],
    "php": [".php"],
    "shell": [".sh", ".bash", ".zsh"],
}
FENCES = {
    "typescript": [".ts"], "tsx": [".tsx"], "javascript": [".js", ".mjs", ".cjs"], "jsx": [".jsx"], "python": [".py"], "ruby": [".rb"],
    "go": [".go"], "rust": [".rs"], "java": [".java"], "kotlin": [".kt"], "swift": [".swift"], "php": [".php"], "csharp": [".cs"],
    "c": [".c", ".h"], "cpp": [".cpp", ".hpp"], "css": [".css"], "scss": [".scss"], "html": [".html"], "vue": [".vue"], "svelte": [".svelte"],
    "json": [".json"], "yaml": [".yml", ".yaml"], "toml": [".toml"], "markdown": [".md"], "bash": [".sh"], "sql": [".sql"], "xml": [".xml"], "handlebars": [".hbs"],
}
# Patterns of names that hold secrets, and of templates that don't.
SENSITIVE_NAME = r"(?i)^(?:\.env(?:\.[a-zA-Z0-9_-]+)?|id_(?:rsa|dsa|ecdsa|ed25519)|\.?_?netrc|\.(?:npmrc|pypirc|pgpass|htpasswd|git-credentials)|credentials\.json|service-account[\w.-]*\.json)$"
SENSITIVE_EXTENSION = r"(?i)\.(?:pem|key|p12|pfx|keystore|jks|kdbx)$"
SAFE_TEMPLATE = r"(?i)\.(?:example|sample|template|dist|defaults)(?:\.[a-z0-9]+)*$"
BAD_SEGMENT = r"(?i)^(?:CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])(?:\..*)?$|[<>:\"\\|?*\x00-\x1f\x7f]|[\s.]$"


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """The last extension with its dot in lower case, empty for dotfiles and names without one."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def classify_file(path: Column) -> Column:
    name, ext = F.lower(basename(path)), extension(path)
    return (
        F.when(name.isin(GENERATED), "data")
        .when(name.rlike(r"\.min\.(?:js|css)$"), "asset")
        .when(ext.isin([*BINARY, ".svg"]), "asset")
        .when(ext.isin(CODE), "code")
        .when(ext.isin(CONFIG), "config")
        .when(ext.isin(DOC), "doc")
        .otherwise("config")
    )


def _lookup(ext: Column, table: dict[str, list[str]], default: str) -> Column:
    out = F
    for k, v in table.items():
        out = out.when(ext.isin(v), k)
    return out.otherwise(default)


def family(path: Column) -> Column:
    return _lookup(extension(path), FAMILIES, "other")


def fence_language(path: Column) -> Column:
    return _lookup(extension(path), FENCES, "text")


def is_sensitive(name: Column) -> Column:
    return ~name.rlike(SAFE_TEMPLATE) & (name.rlike(SENSITIVE_NAME) | name.rlike(SENSITIVE_EXTENSION))


def slug(path: Column) -> Column:
    """Folder and name in lower case with dashes, cut at 48 characters, and a short hash that tells equal ones apart."""
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    stem = F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")
    base = F.concat(F.when(folder != "", F.concat(F.regexp_replace(folder, r"[/\\]", "-"), F.lit("-"))).otherwise(""), stem)
    base = F.left(F.regexp_replace(F.regexp_replace(F.lower(base), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(48))
    mark = F.left(F.sha1(F.regexp_replace(path, r"\\", "/")), F.lit(6))
    return F.when(base == "", mark).otherwise(F.concat(base, F.lit("-"), mark))


def is_portable(path: Column) -> Column:
    """Inside its root and with segments that any platform can create."""
    plain = F.regexp_replace(path, r"\\", "/")
    parts = F.filter(F.split(plain, "/"), lambda s: s != "")
    return ~F.contains(path, F.lit("\u0000")) & ~F.exists(parts, lambda s: (s == "..") | s.rlike(BAD_SEGMENT))


def is_supported_document(name: Column) -> Column:
    return extension(name).isin(SUPPORTED)


# Folders that a scan from a project's root doesn't enter.
ROOT_SKIPPED = ["node_modules", "converted", ".index", "dist", "out", "release"]


def is_listed_document(path: Column, root_mode: bool) -> Column:
    """Whether a scan lists a path below its root: nothing in or named like a dotfile. A scan of a project's root, in
    place of its folder of documents, lists supported formats alone, and enters none of certain folders."""
    parts = F.split(path, "/")
    listed = ~F.exists(parts, lambda p: F.startswith(p, F.lit(".")))
    if not root_mode:
        return listed
    folders = F.slice(parts, 1, F.size(parts) - 1)
    return listed & ~F.exists(folders, lambda p: p.isin(ROOT_SKIPPED)) & is_supported_document(path)
