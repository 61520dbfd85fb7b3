"""HTML extraction by equivalence-class template deduction.

Pages of one host share a template. A token is a tag, an attribute or a word, told apart by the tag it stands in. Tokens with the same
occurrence vector (how often each page of the host has them) form an equivalence class; it counts if SIZE tokens or more are in it and
SUPPORT of the host's pages have it. A class is valid if its tokens come in one order, again and again, in all but TOLERANCE of its
pages. A valid class whose occurrences all lie in one and the same gap of another is nested in it; a class that lies across the
gaps of another is dropped if it has the fewer tokens. What stands between the tokens of the innermost class is that gap's slot.

Hosts of fewer than MIN_PAGES pages drop out first, by their urls.
1. Candidates: every task counts, over the pages of a host that it sees, which tokens SUPPORT of them have. A token that is frequent
   over all pages is frequent in one task at least, so nothing is lost.
2. Vectors: candidates are counted on all pages; vectors are compared by a sum of hashes of (page, count) and by their support.
3. Validity and nesting are tried on all pages, and 4. slots extracted from all pages. Only per-host lists travel between the passes;
   they are broadcast up to BROADCAST_BYTES, beyond which they are joined by host.

Entities are resolved; scripts, styles, comments and attributes are no text; one that isn't closed reaches to the end of the page. A tag that isn't closed is text. A host of fewer than MIN_PAGES pages, or without a valid class, has no
template: its pages have one slot "0". So have pages without a host. On a page that breaks the order of a class the class is left out. A null page has null
slots, an empty one none. Repeated page_ids count each by itself. Very long pages are read whole; other columns play no part. No rows, no result.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispan.llm.common import shared_folder, written

SUPPORT, SIZE, MIN_PAGES, TOLERANCE = 0.8, 3, 5, 0.01
BROADCAST_BYTES, HOSTS, FLUSH = 32 << 20, 200_000, 400_000
#: A tag ends at the first ">" out of quotes; a "<" before that makes it text. Each attempt stops at the next "<", so a page takes time in proportion to its length.
TAG = re.compile(r"(?i)<(?:!--|(script|style)(?=[\s/>])|!?/?[a-z](?:\"[^\"]*+\"|'[^']*+'|[^\"'<>])*+>)")
CLOSE = {name: re.compile(rf"(?i)</{name}\s*+>") for name in ("script", "style")}
NAME = re.compile(r"<!?/?[a-zA-Z][^\s>/]*")
ATTRIBUTE = re.compile(r"[^\s\"'>/=]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SELF_CLOSING = {"p", "li", "tr", "td", "option"}


def tokens(page: str) -> tuple[list[str], list[str | None]]:
    """Roles of all tokens of a page, and the words among them (None for what is no text)."""
    keys: list[str] = []
    words: list[str | None] = []
    stack, at, inside, open_ = ["", ""], 0, " ", Counter()
    while m := TAG.search(page, at):
        if between := page[at : m.start()].split():
            keys += [inside + w for w in between]
            words += between
        t, at = m[0], m.end()
        if t == "<!--" or m[1]:
            if t == "<!--":
                end = page.find("-->", at)
                at = end + 3 if end >= 0 else len(page)
            else:
                end = CLOSE[m[1].lower()].search(page, at)
                at = end.end() if end else len(page)
            keys.append(inside + t.lower())
            words.append(None)
            continue
        name = NAME.match(t)[0].lower()
        bare = name[1:]
        if bare[0] == "/":
            bare = bare[1:]
            if open_[bare]:
                while (top := stack.pop()) != bare:
                    open_[top] -= 1
                open_[bare] -= 1
                inside = stack[-1] + " "
            keys.append(inside + name)
            words.append(None)
            continue
        if bare in SELF_CLOSING and stack[-1] == bare:
            stack.pop()
            open_[bare] -= 1
            inside = stack[-1] + " "
        keys.append(inside + name)
        words.append(None)
        if bare[0] == "!":
            continue
        if len(t) > len(name) + 2:
            for a in ATTRIBUTE.findall(t[len(name) : -1]):
                keys.append(f"{name} @{a}")
                words.append(None)
        if bare not in VOID and not t.endswith("/>"):
            stack.append(bare)
            open_[bare] += 1
            inside = bare + " "
    if between := page[at:].split():
        keys += [inside + w for w in between]
        words += between
    return keys, words


def hosted(pages: DataFrame) -> DataFrame:
    host = F.nullif(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), "html")


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str | None, str, str | None]]:
    for batch in batches:
        extra = "payload" in batch.schema.names
        for lo in range(0, batch.num_rows, 128):
            part = batch.slice(lo, 128)
            columns = [part.column(k).to_pylist() for k in ("page_id", "host", "html")]
            yield from zip(*columns, part.column("payload").to_pylist() if extra else [None] * part.num_rows)


class _Payload:
    """Parsed list of each host, once per task."""

    def __init__(self, make: Callable):
        self.make, self.seen = make, {}

    def __call__(self, host: str, payload: str):
        if host not in self.seen:
            if len(self.seen) > 10_000:
                self.seen.clear()
            self.seen[host] = self.make(json.loads(payload))
        return self.seen[host]


def _table(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names)


def candidates(pages: DataFrame) -> DataFrame:
    """host, key: every token that SUPPORT of the pages of a host have, and more."""

    def flush(seen: dict[str, Counter], pages_of: Counter) -> Iterator[pa.RecordBatch]:
        for host, counter in seen.items():
            least = SUPPORT * pages_of[host]
            if rows := [(host, k) for k, n in counter.items() if n >= least]:
                yield _table(rows, ["host", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        pages_of, held = Counter(), 0
        for _, host, page, _ in _each(batches):
            counter = seen.setdefault(host, Counter())
            held -= len(counter)
            counter.update(set(tokens(page)[0]))
            held += len(counter)
            pages_of[host] += 1
            if held > FLUSH:
                yield from flush(seen, pages_of)
                seen, pages_of, held = {}, Counter(), 0
        yield from flush(seen, pages_of)

    return pages.mapInArrow(run, "host string, key string").distinct()


def vectors(pages: DataFrame) -> DataFrame:
    """host, key, support, two sums that stand for the occurrence vector, and the sum of first positions; the key "" counts the pages."""

    def flush(found: dict) -> Iterator[pa.RecordBatch]:
        if found:
            yield _table([(h, k, *v) for (h, k), v in found.items()], ["host", "key", "support", "high", "low", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse, found = _Payload(frozenset), {}
        for page_id, host, page, payload in _each(batches):
            wanted, count, place = parse(host, payload), {"": 1}, {"": 0}
            for i, k in enumerate(tokens(page)[0]):
                if k in wanted:
                    if k in count:
                        count[k] += 1
                    else:
                        count[k], place[k] = 1, i
            marks: dict[int, tuple[int, int]] = {}
            salt = f"{page_id}:{xxhash.xxh64_intdigest(page)}:"
            for k, n in count.items():
                if n not in marks:
                    h = xxhash.xxh64_intdigest(f"{salt}{n}")
                    marks[n] = (h >> 32, h & 0xFFFFFFFF)
                v = found.setdefault((host, k), [0, 0, 0, 0])
                v[0] += 1
                v[1] += marks[n][0]
                v[2] += marks[n][1]
                v[3] += place[k]
            if len(found) > FLUSH:
                yield from flush(found)
                found = {}
        yield from flush(found)

    out = pages.mapInArrow(run, "host string, key string, support long, high long, low long, place long")
    return out.groupBy("host", "key").agg(*[F.sum(c).cast("decimal(38,0)").alias(c) for c in ("support", "high", "low", "place")])


def classes(found: DataFrame) -> DataFrame:
    """host, keys: tokens of each class in the order of their first positions."""
    total = found.where("key = ''").select("host", F.col("support").alias("pages"))
    keys = F.transform(F.array_sort(F.collect_list(F.struct("place", "key"))), lambda x: x["key"])
    groups = found.where("key <> ''").groupBy("host", "support", "high", "low").agg(keys.alias("keys")).where(F.size("keys") >= SIZE)
    return groups.join(total, "host").where((F.col("pages") >= MIN_PAGES) & (F.col("support") >= F.col("pages") * SUPPORT)).select("host", "keys")


class _Classes:
    """Places of the keys of a host's classes."""

    def __init__(self, lists: list[list[str]]):
        self.sizes = [len(x) for x in lists]
        self.of = {k: (c, i) for c, keys in enumerate(lists) for i, k in enumerate(keys)}

    def walk(self, keys: list[str]) -> tuple[list[tuple[int, int, int]], set[int], set[int]]:
        """(position, class, index) of all template tokens, the classes present and those out of order."""
        hits, next_, present, bad = [], [0] * len(self.sizes), set(), set()
        of = self.of
        for p, k in enumerate(keys):
            if k in of:
                c, i = of[k]
                present.add(c)
                if i != next_[c]:
                    bad.add(c)
                next_[c] = (i + 1) % self.sizes[c]
                hits.append((p, c, i))
        bad |= {c for c in present if next_[c]}
        return hits, present, bad


def relations(pages: DataFrame) -> DataFrame:
    """host, inner, outer, gap, n: on how many pages a class lies in a gap of another (-1: outside or across); outer -1 counts pages (gap 0 in order, 1 not)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse, found = _Payload(_Classes), Counter()
        for _, host, page, payload in _each(batches):
            known = parse(host, payload)
            hits, present, bad = known.walk(tokens(page)[0])
            for c in present:
                found[host, c, -1, int(c in bad)] += 1
            good = present - bad
            gap, where, changed, seen = dict.fromkeys(good, -1), {}, {}, {}
            for t, (_, c, i) in enumerate(hits):
                if c not in good:
                    continue
                gap[c] = i if i < known.sizes[c] - 1 else -1
                if c not in seen:
                    where |= {(c, a): gap[a] for a in good if a != c}
                else:
                    for a in reversed(changed):  # the latest first; what changed before c was last met says nothing new
                        if changed[a] < seen[c]:
                            break
                        if a != c and where[c, a] != gap[a]:
                            where[c, a] = -1
                changed.pop(c, None)
                changed[c] = seen[c] = t
            for (c, a), g in where.items():
                found[host, c, a, g] += 1
            if len(found) > FLUSH:
                yield from flush(found)
                found = Counter()
        yield from flush(found)

    def flush(found: Counter) -> Iterator[pa.RecordBatch]:
        if found:
            yield _table([(*k, n) for k, n in found.items()], ["host", "inner", "outer", "gap", "n"])

    out = pages.mapInArrow(run, "host string, inner long, outer long, gap long, n long")
    return out.groupBy("host", "inner", "outer", "gap").agg(F.sum("n").alias("n"))


def nested(lists: list[list[str]], facts: list[tuple[int, int, int, int]]) -> list[list[str]]:
    """The classes that are valid and nest in each other, the outermost first."""
    pages, wrong, lies = Counter(), Counter(), {}
    for inner, outer, gap, n in facts:
        if outer < 0:
            pages[inner] += n
            wrong[inner] += n * gap
        else:
            lies.setdefault((inner, outer), Counter())[gap] += n
    valid = [c for c in range(len(lists)) if pages[c] and wrong[c] <= TOLERANCE * pages[c]]
    within = {}
    for a in valid:
        for b in valid:
            if gaps := lies.get((a, b)):
                gap, n = gaps.most_common(1)[0]
                within[a, b] = gap if n >= (1 - TOLERANCE) * gaps.total() else -1
    kept: list[int] = []
    for c in sorted(valid, key=lambda c: (-len(lists[c]), lists[c])):
        # Two classes nest if one lies in one gap of the other; side by side in a gap of a third, neither lies in the other, which is -1 both ways.
        if all(within.get((c, k), -1) >= 0 or within.get((k, c), -1) >= 0 or _apart(c, k, kept, within) for k in kept):
            kept.append(c)
    depth = {c: sum(within.get((c, k), -1) >= 0 for k in kept if k != c) for c in kept}
    return [lists[c] for c in sorted(kept, key=lambda c: (depth[c], lists[c]))]


def _apart(c: int, k: int, kept: list[int], within: dict) -> bool:
    """Whether both lie in different gaps of a class already kept."""
    return any(within.get((c, m), -1) >= 0 and within.get((k, m), -1) >= 0 and within[c, m] != within[k, m] for m in kept if m not in (c, k))


def slots(page: str, known: _Classes | None) -> list[tuple[str, str]]:
    """Slots of a page in its order, with their text; a slot is named by class and gap."""
    keys, words = tokens(page)
    hits, _, bad = known.walk(keys) if known else ([], set(), set())
    marks = {p: (c, i) for p, c, i in hits if c not in bad}
    out: list[tuple[str, str]] = []
    open_: dict[int, int] = {}
    name, text = "0", []

    def close() -> None:
        if text:
            out.append((name, entities.unescape(" ".join(text))))
            text.clear()

    for p, (key, w) in enumerate(zip(keys, words)):
        if p in marks:
            close()
            c, i = marks[p]
            open_.pop(c, None)
            if i < known.sizes[c] - 1:
                open_[c] = i
            inner = max(open_) if open_ else None  # classes are in the order of their depth
            name = "0" if inner is None else f"{inner}.{open_[inner]}"
        elif w is not None:
            text.append(w)
    close()
    return out


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, host and slots (slot, text) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse = _Payload(_Classes)
        for batch in batches:
            done = [None if page is None else [{"slot": s, "text": t} for s, t in slots(page, parse(host, payload) if payload else None)] for _, host, page, payload in _each(iter([batch]))]
            kind = pa.list_(pa.struct([("slot", pa.string()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("host"), pa.array(done, kind)], ["page_id", "host", "slots"])

    spark, folder = pages.sparkSession, shared_folder(pages.sparkSession)
    rows = hosted(pages)
    # Hosts of too few pages are known by their urls alone, and nothing else is read of them before the last pass.
    large = rows.groupBy("host").count().where((F.col("host").isNotNull()) & (F.col("count") >= MIN_PAGES)).select("host")
    usable = rows.where("host IS NOT NULL AND html IS NOT NULL").join(F.broadcast(large) if large.limit(HOSTS + 1).count() <= HOSTS else large, "host", "left_semi").select("page_id", "host", "html")

    def shared(lists: DataFrame, name: str) -> DataFrame:
        """host, payload as a table, to be broadcast if it is small."""
        lists = written(lists, folder, name)
        size = lists.agg(F.coalesce(F.sum(F.octet_length("payload")), F.lit(0))).first()[0]
        return F.broadcast(lists) if size <= BROADCAST_BYTES else lists

    listed = lambda df, what: df.groupBy("host").agg(F.to_json(F.array_sort(F.collect_list(what))).alias("payload"))
    wanted = shared(listed(candidates(usable), "key"), "candidates")
    counted = written(vectors(usable.join(wanted, "host")), folder, "vectors")  # read twice, made once
    first = shared(listed(classes(counted), "keys"), "classes")
    facts = relations(usable.join(first, "host")).groupBy("host").agg(F.to_json(F.collect_list(F.array("inner", "outer", "gap", "n"))).alias("facts"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, payload, facts = (batch.column(k).to_pylist() for k in ("host", "payload", "facts"))
            done = [(h, nested(json.loads(x), json.loads(f))) for h, x, f in zip(host, payload, facts)]
            if rows := [(h, json.dumps(x)) for h, x in done if x]:
                yield _table(rows, ["host", "payload"])

    final = shared(spark.read.parquet(f"{folder}/classes").join(facts, "host").mapInArrow(settle, "host string, payload string"), "templates")
    return rows.join(final, "host", "left").mapInArrow(run, "page_id long, host string, slots array<struct<slot:string,text:string>>")
