"""Redirects followed over a table of captures, by jumps of doubling length.

Every captured URL knows where it leads after 1, 2, 4 ... hops, each table made of the one before by one join, so that
chains, cycles and hubs of any shape take five joins for twenty hops and no URL is followed one hop at a time.

Defined results: a capture redirects if its status is 300 to 399 and it has a location, which is resolved against its URL;
of several captures of a URL the smallest (status, location) counts; captures without a URL are not read. A chain that has
not ended after `most` hops, as every cycle, has too many; one that leads to an address that may not be fetched is
forbidden; one that leaves the table is not captured; a location that is no URL ends it where it stands. A request without a URL is forbidden. 301, 302 and 303 turn
what follows into GET. Repeated requests are each followed; an empty table of requests gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.policy import url_forbidden
from tessella.functions.urls import host, path, scheme
from tessella.operators.cookies import headers_as_of, parse_set_cookie
from tessella.operators.dom import resolve
from tessella.operators.joins import join_unique
from tessella.sources.staging import discard, materialize

#: Fixed value: hops after which a request is given up.
MOST = 20
OK, MISSING, MANY, FORBIDDEN, BAD = "ok", "not_captured", "too_many_redirects", "forbidden", "bad_location"


class Chains:
    """(url, to, hops, get, status, outcome) after up to 2^k hops, for each k; outcome is null while more hops follow."""

    def __init__(self, captures: DataFrame, most: int = MOST) -> None:
        self.most, self.jumps = most, []
        first = captures.where("url IS NOT NULL").groupBy("url").agg(F.min(F.struct("status", "location")).alias("c")).select("url", "c.*")
        leads = F.coalesce(F.col("status").between(300, 399) & F.col("location").isNotNull(), F.lit(False))
        hop = first.withColumns({"on": leads, "next": F.when(leads, resolve(F.col("location"), F.col("url")))})
        moved = F.col("next").isNotNull()
        outcome = F.when(~F.col("on"), OK).when(~moved, BAD).when(F.coalesce(url_forbidden(F.col("next")), F.lit(True)), FORBIDDEN)
        hop = hop.select(
            "url", F.coalesce("next", "url").alias("to"), F.when(moved, 1).otherwise(0).alias("hops"), (moved & F.col("status").isin(301, 302, 303)).alias("get"),
            F.when(~F.col("on"), F.col("status")).alias("status"), outcome.alias("outcome"),
        )
        self.jumps.append(materialize(hop))
        while 1 << (len(self.jumps) - 1) <= most:
            self.jumps.append(materialize(self._further(self.jumps[-1], self.jumps[-1], F.col("url"))))

    @staticmethod
    def _further(rows: DataFrame, jump: DataFrame, spread: Column) -> DataFrame:
        """rows that go on, one jump further; the others as they are."""
        names = rows.columns
        onward = rows.withColumn("__from", F.when(F.col("outcome").isNull(), F.col("to")))
        ahead = jump.select(F.col("url").alias("__from"), F.col("to").alias("__to"), F.col("hops").alias("__hops"), F.col("get").alias("__get"), F.col("status").alias("__status"), F.col("outcome").alias("__outcome"), F.lit(True).alias("__there"))
        out = join_unique(onward, ahead, "__from", spread)
        out = out.withColumns({
            "to": F.coalesce("__to", "to"), "hops": F.col("hops") + F.coalesce("__hops", F.lit(0)), "get": F.col("get") | F.coalesce("__get", F.lit(False)), "status": F.coalesce("__status", "status"),
            "outcome": F.when(F.col("__from").isNotNull() & F.col("__there").isNull(), MISSING).otherwise(F.coalesce("outcome", "__outcome")),
        })
        return out.select(names)

    def exactly(self, rows: DataFrame, at: str, steps: Column | int, spread: Column) -> DataFrame:
        """rows whose `at` has moved on by so many hops, which its chain must have."""
        for k, jump in enumerate(self.jumps):
            if isinstance(steps, int):
                if not steps >> k & 1:
                    continue
                moves = F.lit(True)
            else:
                moves = F.shiftright(steps, k).bitwiseAND(1) == 1
            moving = rows.withColumn("__from", F.when(moves, F.col(at)))
            rows = materialize(join_unique(moving, jump.select(F.col("url").alias("__from"), F.col("to").alias("__to")), "__from", spread).withColumn(at, F.coalesce("__to", at)).drop("__from", "__to"))
        return rows

    def follow(self, requests: DataFrame, key: str) -> DataFrame:
        """requests(key, url, method) with to, hops, get, status and outcome of their whole chains; hops may exceed the most."""
        start = requests.select(key, "url", "method", F.col("url").alias("to"), F.lit(0).alias("hops"), F.lit(False).alias("get"), F.lit(None).cast("int").alias("status"), F.when(F.coalesce(url_forbidden(F.col("url")), F.lit(True)), FORBIDDEN).alias("outcome"))
        return self._further(start, self.jumps[-1], F.xxhash64(key))

    def discard(self) -> None:
        for jump in self.jumps:
            discard(jump)


def resolve_redirects(requests: DataFrame, captures: DataFrame, key: str, most: int = MOST) -> DataFrame:
    """(key, final_url, status, n_hops, method, outcome) of requests(key, url, method) over captures(url, status, location).

    final_url is where a chain ended or was given up; status and method are null unless it ended in a capture."""
    chains = Chains(captures, most)
    far = materialize(chains.follow(requests, key))
    many = (F.col("hops") >= most) & (F.coalesce("outcome", F.lit(MANY)) != FORBIDDEN) | (F.col("hops") > most)
    far = far.withColumn("outcome", F.when(many, MANY).otherwise(F.col("outcome")))
    cut = chains.exactly(far.where(F.col("outcome") == MANY).withColumn("to", F.col("url")), "to", most, F.xxhash64(key)).withColumn("hops", F.lit(most))
    every = far.where(F.col("outcome") != MANY).unionByName(cut)
    ended = F.col("outcome") == OK
    return every.select(key, F.col("to").alias("final_url"), F.when(ended, F.col("status")).alias("status"), F.col("hops").alias("n_hops"), F.when(ended, F.when(F.col("get"), "GET").otherwise(F.col("method"))).alias("method"), "outcome")


def redirect_hops(requests: DataFrame, captures: DataFrame, key: str, most: int = MOST) -> DataFrame:
    """(key, step, hop_url): every URL on a request's way, its own first, in order; a chain that is given up has `most` + 1."""
    chains = Chains(captures, most)
    far = chains.follow(requests, key).where("url IS NOT NULL").select(key, "url", F.least("hops", F.lit(most)).alias("hops"))
    steps = materialize(far.select(key, F.explode(F.sequence(F.lit(0), F.col("hops"))).alias("step"), F.col("url").alias("hop_url")))
    return chains.exactly(steps, "hop_url", F.col("step"), F.xxhash64(key, "step")).select(key, "step", "hop_url")


def redirect_cookies(requests: DataFrame, captures: DataFrame, key: str, now: Column, most: int = MOST) -> DataFrame:
    """(key, step, header): what each hop of each request sends of the cookies that the hops before it set; each request has a jar
    of its own. captures have set_cookie too, an array of headers, of which those of the smallest (status, location) count.

    A hop's answer is seen by later hops only, so cookies take effect one step on. Hops that send nothing have no row.
    """
    hops = materialize(redirect_hops(requests, captures, key, most))
    answers = captures.where("url IS NOT NULL").groupBy("url").agg(F.min_by("set_cookie", F.struct("status", "location")).alias("set_cookie"))
    said = join_unique(hops, answers.select(F.col("url").alias("hop_url"), "set_cookie"), "hop_url", F.xxhash64(key, "step"))
    log = said.select(key, "step", "hop_url", F.posexplode("set_cookie").alias("at", "header"))
    log = log.select(key, F.struct((F.col("step") + 1).alias("step"), F.col("at").alias("at")).alias("when"), "header", host(F.col("hop_url")).alias("host"), path(F.col("hop_url")).alias("origin_path"), now.alias("now"))
    parsed = parse_set_cookie(log.withColumn("way", F.col("origin_path")), "header", F.col("host"), "way", "now")
    last = F.struct(F.col("step").alias("step"), F.lit((1 << 31) - 1).alias("at"))
    asked = hops.select(key, "step", F.struct(key, "step").alias("ask"), last.alias("when"), scheme(F.col("hop_url")).alias("scheme"), host(F.col("hop_url")).alias("host"), path(F.col("hop_url")).alias("path"), now.alias("now"))
    # A chain has some twenty hops: few rows to a jar, so histories need no ranges.
    sent = headers_as_of(asked, parsed, "ask", "when", "now", jar=(key,), ranges=1)
    return sent.select(F.col(f"ask.{key}").alias(key), F.col("ask.step").alias("step"), "header")
