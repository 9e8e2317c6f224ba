"""Git as a Spark data source: spark.read.format("revlens_git").option("path", ...).option("table", "commits" | "modifications" | "lines" | "contents" | "refs" | "files" | "blame").

contents are the texts of all files whose names end in one of the option endings (by commas), in each commit that changes one of them against its first parent.
Commits that the option known (by spaces) names, and all before them, are left out.
With the option nloc, modifications have the lines of code of the new file, without blank lines and comments.
place is the commits' order in Git's list, parents before children.
Filters on rev, parent_num and committer_ts are pushed down: commits and parents that they leave out are never diffed. Filters on path spare the rows of other files.
"""

from __future__ import annotations

import operator
import re
import subprocess
import tempfile
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMAS = {
    "commits": "rev string, parents array<string>, author string, committer_ts timestamp, committer_local timestamp_ntz, tz_offset_min int, msg string, place long",
    "modifications": "rev string, parent_num int, mod_idx int, change_type string, old_path string, new_path string, added int, removed int, nloc int, committer_ts timestamp",
    "lines": "rev string, parent_num int, path string, kind string, line int, text string, committer_ts timestamp",
    "contents": "rev string, path string, text string",
    "refs": "name string, rev string",
    "files": "rev string, path string",
    "blame": "rev string, path string, inducing string, file string, lo int, hi int",
}
KINDS = {"A": "ADD", "M": "MODIFY", "D": "DELETE", "R": "RENAME", "C": "COPY", "T": "MODIFY"}
COMPARED = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


def git(path: str, *args: str, given: str | None = None) -> str:
    return subprocess.run(["git", "-C", path, *args], input=None if given is None else given.encode(), capture_output=True, check=True).stdout.decode("utf-8", "replace")


def git_lines(path: str, *args: str, given: str) -> Iterator[str]:
    """The output line by line, while the process runs. What it is given must be short beside a pipe or read before it answers: a file holds it."""
    with tempfile.TemporaryFile() as asked:
        asked.write(given.encode())
        asked.seek(0)
        with subprocess.Popen(["git", "-C", path, *args], stdin=asked, stdout=subprocess.PIPE) as p:
            for line in p.stdout:
                yield line.decode("utf-8", "replace").removesuffix("\n")
        if p.returncode:
            raise subprocess.CalledProcessError(p.returncode, p.args)


C_STYLE = (".c", ".cc", ".cpp", ".cs", ".go", ".h", ".hpp", ".java", ".js", ".kt", ".php", ".rs", ".scala", ".swift", ".ts")
HASH_STYLE = (".py", ".rb", ".sh")
STRING = r"""\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"""


def code_length(name: str, text: str) -> int | None:
    """Lines that hold more than white space and comments; None for files whose comments aren't known."""
    comment = r"/\*.*?(?:\*/|\Z)|//[^\n]*" if name.endswith(C_STYLE) else r"#[^\n]*" if name.endswith(HASH_STYLE) else None
    if comment is None:
        return None
    bare = re.sub(f"{STRING}|({comment})", lambda m: "\n" * m[0].count("\n") if m[1] else m[0], text, flags=re.S)
    return sum(bool(line.strip()) for line in bare.split("\n"))


def unquoted(name: str) -> str:
    """A path as Git prints it: in quotes with backslashes where it holds unusual bytes."""
    if not (len(name) > 1 and name[0] == name[-1] == '"'):
        return name
    return name[1:-1].encode("latin-1", "replace").decode("unicode_escape").encode("latin-1", "replace").decode("utf-8", "replace")


def side(line: str) -> str:
    """The path of a --- or +++ line; nothing for /dev/null. A tab ends names that hold spaces."""
    name = unquoted(line[4:].removesuffix("\t"))
    return "" if name == "/dev/null" else name[2:]


class Range(InputPartition):
    def __init__(self, revs):
        super().__init__(revs)
        self.revs = revs


class GitReader(DataSourceReader):
    """One partition for each few hundred commits; a commit's tables need nothing of other commits."""

    def __init__(self, options, table):
        self.path, self.table, self.at = options["path"], table, options.get("rev", "")
        self.file, self.per = options.get("file", ""), int(options.get("per", "500"))
        self.known = options.get("known", "").split()
        self.endings = tuple(options.get("endings", "pom.xml").split(","))
        self.nloc = options.get("nloc", "false") == "true"
        self.tests: list[tuple] = []

    def pushFilters(self, filters):
        """Takes comparisons of rev, parent_num, path and committer_ts with values; gives back all others."""
        usable = {"commits": ("rev", "committer_ts"), "modifications": ("rev", "parent_num", "committer_ts"), "lines": ("rev", "parent_num", "path", "committer_ts"), "contents": ("rev",)}.get(self.table, ())
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in usable and type(f) in COMPARED and f.value is not None:
                self.tests.append((name, type(f).__name__, f.value))
            elif name in usable and isinstance(f, In):
                self.tests.append((name, "In", tuple(f.value)))
            else:
                yield f

    def fits(self, name, value) -> bool:
        """Whether a value passes the tests on its column."""
        for column, kind, other in self.tests:
            if column == name and kind == "In" and value not in other:
                return False
            if column == name and kind != "In" and not {k.__name__: v for k, v in COMPARED.items()}[kind](value, other):
                return False
        return True

    def at_time(self, seconds: str) -> datetime:
        """A commit's time, as comparable with the filters' values."""
        t = datetime.fromtimestamp(int(seconds), timezone.utc)
        naive = any(isinstance(v, datetime) and v.tzinfo is None for c, _, o in self.tests if c == "committer_ts" for v in (o if isinstance(o, tuple) else (o,)))
        return t.astimezone().replace(tzinfo=None) if naive else t

    def partitions(self):
        if self.table in ("refs", "files", "blame"):
            return [Range([self.at])]
        listed = git(self.path, "rev-list", "--all", "--topo-order", "--reverse", "--no-commit-header", "--format=%H %ct %P", "--ignore-missing", *(f"^{rev}" for rev in self.known)).splitlines()
        kept = []
        for place, line in enumerate(listed):
            rev, when, *parents = line.split()
            if self.fits("rev", rev) and self.fits("committer_ts", self.at_time(when)):
                kept.append((rev, int(when), tuple(parents), place))
        return [Range(kept[i : i + self.per]) for i in range(0, len(kept), self.per)] or [Range([])]

    def read(self, partition):
        yield from getattr(self, f"_{self.table}")(partition.revs)

    def _refs(self, _):
        for line in git(self.path, "for-each-ref", "--format=%(refname)%09%(objectname)").splitlines():
            yield tuple(line.split("\t"))

    def _files(self, revs):
        rev = revs[0] or "HEAD"
        for p in git(self.path, "ls-tree", "-r", "-z", "--name-only", rev).split("\0"):
            if p:
                yield rev, p

    def _commits(self, revs):
        """One process for all commits of a range."""
        asked = "".join(f"{rev}\n" for rev, *_ in revs)
        places = {rev: place for rev, _, _, place in revs}
        shown = git(self.path, "log", "--no-walk=unsorted", "--stdin", "-s", "--format=%x01%H%x00%P%x00%ae%x00%cI%x00%B", given=asked) if revs else ""
        for one in shown.split("\1")[1:]:
            h, parents, author, when, msg = one.split("\0", 4)
            local = datetime.fromisoformat(when)
            yield h, parents.split(), author, local.astimezone(timezone.utc), local.replace(tzinfo=None), int(local.utcoffset().total_seconds() // 60), msg.strip("\n"), places[h]

    def pairs(self, revs):
        """(rev, parent number, time) of what is to be diffed, and what diff-tree is asked for it."""
        of = [(rev, num, datetime.fromtimestamp(when, timezone.utc), parent) for rev, when, parents, _ in revs for num, parent in enumerate(parents or [""]) if self.fits("parent_num", num)]
        return [p[:3] for p in of], "".join(f"{rev} {parent}\n" for rev, _, _, parent in of)

    def _modifications(self, revs):
        """One process for all commits and parents of a range."""
        of, asked = self.pairs(revs)
        if not of:
            return
        rows = list(self.changes(of, asked))
        sizes = self.code_lengths({(blob, row[5]) for row, blob in rows if row[5]}) if self.nloc else {}
        for (*row, when), blob in rows:
            yield *row, sizes.get((blob, row[5])), when

    def code_lengths(self, blobs: set[tuple[str, str]]) -> dict[tuple[str, str], int]:
        """The length of code of blobs (id, name), read one after another from one process."""
        of = sorted((b, n) for b, n in blobs if n.endswith(C_STYLE + HASH_STYLE))
        return {(b, n): code_length(n, text) for (b, n), text in zip(of, self.blobs([b for b, _ in of]), strict=True) if text is not None}

    def changes(self, of, asked):
        shown = git(self.path, "diff-tree", "--stdin", "-r", "-M", "-z", "--root", "--always", "--raw", "--numstat", "--format=%x01", given=asked)
        for (rev, num, when), one in zip(of, shown.split("\1")[1:], strict=True):
            part = iter(one.lstrip("\0\n").split("\0"))
            kinds, counts = [], []
            for field in part:
                field = field.lstrip("\n")
                if field.startswith(":"):
                    *_, blob, letter = field.split(" ")
                    old = next(part)
                    kinds.append((KINDS.get(letter[0], "MODIFY"), old, next(part) if letter[0] in "RC" else old, blob))
                elif "\t" in field:
                    a, r, name = field.split("\t", 2)
                    if not name:  # renames have their paths after
                        next(part), next(part)
                    counts.append((a, r))
            for k, ((kind, old, new, blob), (a, r)) in enumerate(zip(kinds, counts, strict=True)):
                yield (rev, num, k, kind, None if kind == "ADD" else old, None if kind == "DELETE" else new, int(a) if a != "-" else 0, int(r) if r != "-" else 0, when), blob

    def _lines(self, revs):
        """Added and deleted lines by number, against each parent; white space alone is no change. One process for all of a range, read while it runs."""
        of, asked = self.pairs(revs)
        if not of:
            return
        todo = iter(of)
        names, at, head, left = {"-": "", "+": ""}, {"-": 0, "+": 0}, True, {"-": 0, "+": 0}
        for line in git_lines(self.path, "diff-tree", "--stdin", "-r", "-M", "-w", "-U0", "-p", "--no-color", "--root", "--always", "--format=%x01", given=asked):
            sign = line[:1]
            if sign in left and left[sign]:
                if self.fits("path", names[sign]):
                    yield rev, num, names[sign], "deleted" if sign == "-" else "added", at[sign], line[1:], when
                at[sign] += 1
                left[sign] -= 1
            elif line == "\1":
                rev, num, when = next(todo)
            elif line.startswith("diff --git "):
                head = True
            elif head and line.startswith(("--- ", "+++ ")):
                names[sign] = side(line)
            elif line.startswith("@@ "):
                head = False
                for s, part in zip("-+", line.split(" ")[1:3]):
                    start, _, n = part[1:].partition(",")
                    at[s], left[s] = int(start), int(n or 1)

    def _contents(self, revs):
        """A process for each commit that changes such a file, for its tree, and one for all texts of the range."""
        of = [(rev, parents[0] if parents else "") for rev, _, parents, _ in revs]
        if not of:
            return
        shown = git(self.path, "diff-tree", "--stdin", "-r", "-z", "--root", "--always", "--name-only", "--format=%x01", given="".join(f"{rev} {parent}\n" for rev, parent in of))
        changed = [rev for (rev, _), one in zip(of, shown.split("\1")[1:], strict=True) if any(p.endswith(self.endings) for p in one.split("\0"))]
        for rev in changed:
            tree = [entry.split("\t", 1) for entry in git(self.path, "ls-tree", "-r", "-z", rev).split("\0") if entry]
            own = [(meta.split(" ")[2], name) for meta, name in tree if name.endswith(self.endings) and meta.split(" ")[1] == "blob"]
            for (_, name), text in zip(own, self.blobs([b for b, _ in own]), strict=True):
                yield rev, name, text

    def blobs(self, ids: list[str]) -> Iterator[str | None]:
        """The texts of blobs, one after another from one process; None where one is missing."""
        with tempfile.TemporaryFile() as asked:
            asked.write("".join(f"{b}\n" for b in ids).encode())
            asked.seek(0)
            with subprocess.Popen(["git", "-C", self.path, "cat-file", "--batch"], stdin=asked, stdout=subprocess.PIPE) as p:
                for _ in ids:
                    size = p.stdout.readline().split()[-1]
                    yield p.stdout.read(int(size) + 1).decode("utf-8", "replace").removesuffix("\n") if size.isdigit() else None

    def _blame(self, revs):
        rev, out, names = revs[0] or "HEAD", [], {}
        for line in git(self.path, "blame", "--incremental", "-w", rev, "--", self.file).splitlines():
            part = line.split(" ")
            if len(part) == 4 and len(part[0]) == 40:
                sha, _, lo, n = part
                out.append((sha, int(lo), int(lo) + int(n) - 1))
            elif line.startswith("filename "):
                names[len(out) - 1] = unquoted(line[9:])
        for k, (sha, lo, hi) in enumerate(out):
            yield rev, self.file, sha, names.get(k, self.file), lo, hi


class GitSource(DataSource):
    @classmethod
    def name(cls):
        return "revlens_git"

    def schema(self):
        return SCHEMAS[self.options.get("table", "commits")]

    def reader(self, schema):
        return GitReader(self.options, self.options.get("table", "commits"))


def register(spark) -> None:
    """Makes the source known, and lets Python sources have filters, unless the session says otherwise itself."""
    key = "spark.sql.python.filterPushdown.enabled"
    if key not in spark.conf.getAll:
        spark.conf.set(key, "true")
    spark.dataSource.register(GitSource)
