"""Documents to the orders they belong to: by the number they state, through the invoice they credit, or by score.

Defined cases: null and empty keys join nothing; of several stated numbers the first that holds is taken; a document whose
candidates all stay under ``least`` has no link; ties go to the smaller order; repeated candidates count once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerquarry.functions.text import jaccard, line_match, supplier_score, words
from ledgerquarry.runtime import cut, default_partitions

# The weights of supplier, value, time and lines in a link's score, and the scores of the two date windows.
WEIGHTS = {"supplier": 0.35, "value": 0.25, "time": 0.15, "lines": 0.25}
NEAR_DAYS, FAR_DAYS, FAR_SHARE = (0, 45), (-3, 90), 0.3


def stated_links(docs: DataFrame, orders: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, po): the first order number of ``numbers`` that exists and whose supplier is the document's.

    ``docs``: doc_id, numbers array<string>, supplier_key; ``orders``: po, supplier_key, one row each.
    """
    asked = docs.select("doc_id", "supplier_key", F.posexplode("numbers").alias("at", "po"))
    met = asked.join(orders.select("po", F.col("supplier_key").alias("__key")), "po").where(supplier_score(F.col("supplier_key"), F.col("__key")) >= least)
    return met.groupBy("doc_id").agg(F.min_by("po", F.struct("at", "po")).alias("po"))


def credit_links(credits: DataFrame, invoices: DataFrame) -> DataFrame:
    """(doc_id, invoice_id, po): the first invoice a credit note quotes that is held, and that invoice's order, null if it
    has none. ``credits``: doc_id, originals array<string>; ``invoices``: doc_id, number, po."""
    asked = credits.select("doc_id", F.posexplode("originals").alias("at", "number"))
    met = asked.join(invoices.select(F.col("doc_id").alias("invoice_id"), "number", "po"), "number")
    best = met.groupBy("doc_id").agg(F.min_by(F.struct("invoice_id", "po"), F.struct("at", "invoice_id")).alias("b"))
    return best.select("doc_id", "b.invoice_id", "b.po")


def best_order_lines(lines: DataFrame, order_lines: DataFrame, least: float = 0.6) -> DataFrame:
    """(doc_id, line_no, po, po_line_no, score): for each line of a linked document (doc_id, po, line_no, sku, description)
    the line of its order (po, po_line_no, po_sku, po_description) it fits best, the first of equals."""
    pairs = lines.join(order_lines, "po").withColumn("score", F.round(line_match(F.col("sku"), F.col("description"), F.col("po_sku"), F.col("po_description")), 6))
    best = pairs.where(F.col("score") >= least).groupBy("doc_id", "line_no", "po").agg(F.min_by(F.struct("po_line_no", "score"), F.struct(-F.col("score"), "po_line_no")).alias("b"))
    return best.select("doc_id", "line_no", "po", "b.po_line_no", "b.score")


def candidate_score(supplier: Column, doc_c: Column, order_c: Column, days: Column, share: Column) -> Column:
    """How well an order explains a document: supplier score, closeness of values in cents (half of its weight counts
    nothing where a value is missing), days from order to document, and share of lines that fit."""
    value = F.when((doc_c != 0) & (order_c != 0), F.greatest(F.lit(0.0), 1 - F.abs(doc_c - order_c) / order_c)).otherwise(0.0)
    time = F.when(days.between(*NEAR_DAYS), 1.0).when(days.between(*FAR_DAYS), FAR_SHARE).otherwise(0.0)
    parts = {"supplier": supplier, "value": value, "time": time, "lines": F.coalesce(share, F.lit(0.0))}
    total = F.lit(0.0)
    for name, part in parts.items():
        total = total + WEIGHTS[name] * F.coalesce(part, F.lit(0.0))
    return F.round(total, 6)


#: Candidate pairs that are met in one pass.
PASS_PAIRS = 400_000_000
#: Least ``line_match`` of a line that counts as a line of the order.
LEAST_LINE = 0.6
#: Months of a key of the goods: a document looks into its own period and the one before.
PERIOD = 4


def scored_links(docs: DataFrame, lines: DataFrame, orders: DataFrame, order_lines: DataFrame, *, least: float = 0.6, pass_pairs: int = PASS_PAIRS) -> DataFrame:
    """(doc_id, po, score): the order with the best ``candidate_score`` of at least ``least``.

    ``docs``: doc_id, supplier_key, net_c, day; ``orders``: po, supplier_key, net_c, day. Candidates are the orders that
    have the document's supplier and its value to the cent, or its supplier in the month of the document or one of the
    three before, or the code of one of its lines. Documents alike in all that is compared are compared once; of such orders
    only the smallest can be the best. Texts are compared once (``_fits``), and candidates only where they may come to
    ``least``: of a supplier's orders those with goods of the document, the others without lines; of the orders with a code
    of the document those whose supplier, value and time may lift them over what is found so. Only such pairs are shuffled,
    and the best of a task. Documents are taken in passes of about ``pass_pairs`` candidates.
    """
    doc_forms = _alike(docs, lines, "doc_id", ("line_no", "sku", "description"))
    order_forms = _alike(orders, order_lines, "po", ("po_sku", "po_description"))
    docs, lines = (cut(d.join(doc_forms.select(F.col("first").alias("doc_id")), "doc_id", "left_semi")) for d in (docs, lines))
    orders, order_lines = (cut(d.join(order_forms.select(F.col("first").alias("po")), "po", "left_semi")) for d in (orders, order_lines))
    doc_texts = cut(lines.select("sku", "description").distinct().withColumn("text", F.monotonically_increasing_id()))
    order_texts = cut(order_lines.select("po_sku", "po_description").distinct().withColumn("goods", F.monotonically_increasing_id()))
    fits = cut(_fits(doc_texts, order_texts))
    texts = lines.join(doc_texts, [lines[c].eqNullSafe(doc_texts[c]) for c in ("sku", "description")]).select("doc_id", "line_no", lines["sku"], "text")
    fitting = texts.where("line_no is not null").join(fits, "text").groupBy("doc_id", "line_no").agg(F.array_distinct(F.flatten(F.collect_list("fits"))).alias("fits"))
    own = texts.groupBy("doc_id").agg(F.count_distinct("line_no").alias("n"), F.array_distinct(F.filter(F.collect_set(_code("sku")), lambda c: c != "")).alias("codes"))
    heads = docs.join(own, "doc_id", "left").join(fitting.groupBy("doc_id").agg(F.collect_list("fits").alias("lines")), "doc_id", "left")
    heads = cut(heads.withColumns({"lines": F.coalesce("lines", F.array().cast("array<array<bigint>>")), "month": _month("day")}))
    goods = order_lines.join(order_texts, [order_lines[c].eqNullSafe(order_texts[c]) for c in ("po_sku", "po_description")])
    goods = goods.groupBy("po").agg(F.collect_set("goods").alias("goods"), F.filter(F.collect_set(_code(order_lines["po_sku"])), lambda c: c != "").alias("o_codes"))
    targets = orders.select("po", *[F.col(c).alias(f"o_{c}") for c in ("supplier_key", "net_c", "day")], _month("day").alias("o_month")).join(goods, "po", "left")
    targets = cut(_ranked(targets.withColumn("goods", F.coalesce("goods", F.array().cast("array<bigint>")))))
    near = cut(_near(heads, targets, _sure(least)))
    heads = cut(heads.join(near, "supplier_key", "left"))
    per_key = lambda d, *key: d.groupBy(*key).count()
    counts = []
    for a, b in ((heads.select("supplier_key", F.explode(F.sequence(F.col("month") - 3, "month")).alias("m")), targets.select(F.col("o_supplier_key").alias("supplier_key"), F.col("o_month").alias("m"))), (heads.select(F.explode("codes").alias("m")), targets.select(F.explode("o_codes").alias("m")))):
        counts.append(per_key(a, *a.columns).join(per_key(b, *a.columns).withColumnRenamed("count", "other"), a.columns).agg(F.coalesce(F.sum(F.col("count") * F.col("other")), F.lit(0))).collect()[0][0])
    passes = 1 + sum(counts) // pass_pairs
    best = [cut(_best_of(heads.where(F.pmod(F.xxhash64("doc_id"), F.lit(passes)) == i), targets, least)) for i in range(passes)]
    out = reduce(DataFrame.unionByName, best).withColumnRenamed("doc_id", "first").join(doc_forms, "first")
    return out.select(F.explode("members").alias("doc_id"), "po", "score")


def _alike(heads: DataFrame, lines: DataFrame, key: str, parts: tuple[str, ...]) -> DataFrame:
    """(first, members): the rows of ``heads`` that agree in all but ``key``, and in the ``parts`` of their lines."""
    own = lines.groupBy(key).agg(F.array_sort(F.collect_set(F.struct(*parts))).alias("own"))
    content = [c for c in heads.columns if c != key]
    return cut(heads.join(own, key, "left").groupBy(*content, "own").agg(F.min(key).alias("first"), F.collect_set(key).alias("members")))


def _code(c: Column | str) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))), "[^A-Z0-9]", "")


def _month(c: str) -> Column:
    return F.year(c) * 12 + F.month(c)


def _fits(doc_texts: DataFrame, order_texts: DataFrame) -> DataFrame:
    """(text, fits): the ``goods`` whose ``line_match`` with a text (text, sku, description) is at least ``LEAST_LINE``, by
    equi-joins: on the code, on the stretches of the description as long as a code, and on words. Texts that share so many
    of their words share one of the first few in any one order of words; the rarest come first."""
    a = cut(doc_texts.select("text", _code("sku").alias("a"), _code("description").alias("run"), words(F.col("description")).alias("w")))
    b = cut(order_texts.select("goods", _code("po_sku").alias("b"), words(F.col("po_description")).alias("o_w")))
    by_code = a.where("a <> ''").join(b.where("b <> ''"), F.col("a") == F.col("b")).select("text", "goods")
    lengths = sorted(r[0] for r in b.where("b <> ''").select(F.length("b")).distinct().collect())  # as many as a code has signs at most
    stretches = F.flatten(F.transform(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: F.when(F.length("run") >= n, F.transform(F.sequence(F.lit(1), F.length("run") - n + 1), lambda i: F.substring(F.col("run"), i, n))).otherwise(F.array().cast("array<string>"))))
    by_run = a.where("a = ''").select("text", F.explode(F.array_distinct(stretches)).alias("b")).join(b.where("b <> ''"), "b").select("text", "goods")
    of = [a.select(F.col("text").alias("id"), F.explode("w").alias("word")), b.select(F.col("goods").alias("id"), F.explode("o_w").alias("word"))]
    often = cut(of[0].unionByName(of[1]).groupBy("word").count())
    firsts = []
    for d, name in zip(of, ("text", "goods")):
        ranked = d.join(often, "word").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("count", "word"))).alias("r"))
        most = F.size("r") - F.ceil((LEAST_LINE - 0.001) * F.size("r")).cast("int") + 1
        firsts.append(ranked.select(F.col("id").alias(name), F.explode(F.slice(F.col("r"), F.lit(1), most)).alias("r")).select(name, F.col("r.word").alias("word")))
    share = firsts[0].join(firsts[1], "word").select("text", "goods").distinct().join(a, "text").join(b, "goods")
    by_words = share.where((F.col("a") == "") | (F.col("b") == "")).where(F.round(jaccard(F.col("w"), F.col("o_w")), 6) >= LEAST_LINE).select("text", "goods")
    return by_code.unionByName(by_run).unionByName(by_words).groupBy("text").agg(F.collect_set("goods").alias("fits"))


def _sure(least: float) -> float:
    """The supplier score under which a pair doesn't come to ``least`` by time and lines alone."""
    return (least - 1e-6 - WEIGHTS["time"] - WEIGHTS["lines"]) / WEIGHTS["supplier"]


def _near(heads: DataFrame, targets: DataFrame, sure: float) -> DataFrame:
    """(supplier_key, near): of the suppliers that meet one in a code, those with a score of at least ``sure``."""
    a = heads.select("supplier_key", F.explode("codes").alias("c")).distinct()
    b = targets.select("o_supplier_key", F.explode("o_codes").alias("c")).distinct()
    pairs = a.join(b, "c").select("supplier_key", "o_supplier_key").distinct()
    return pairs.where(supplier_score(F.col("supplier_key"), F.col("o_supplier_key")) >= sure).groupBy("supplier_key").agg(F.collect_set("o_supplier_key").alias("near"))


def _best_of(heads: DataFrame, targets: DataFrame, least: float) -> DataFrame:
    days = F.datediff("day", "o_day")
    net, o_net = F.coalesce("net_c", F.lit(0)), F.coalesce("o_net_c", F.lit(0))
    score = lambda supplier, share: candidate_score(supplier, net, o_net, days, share)
    suppliers = supplier_score(F.col("supplier_key"), F.col("o_supplier_key"))
    hits = F.size(F.filter("lines", lambda line: F.arrays_overlap(line, F.col("goods"))))
    kept = lambda d, s: d.withColumn("score", s).where(F.col("score") >= least).select("doc_id", (F.round(F.col("score") * MILLION).cast("bigint") * RANKS + (RANKS - 1 - F.col("rank"))).alias("top"))
    exact = lambda d: kept(d, score(suppliers, F.try_divide(hits, "n")))
    top = lambda d: d.groupBy("doc_id").agg(F.max("top").alias("top"))
    same = (F.col("supplier_key") == F.col("o_supplier_key")) & (F.col("supplier_key") != "")
    in_months = (F.col("month") - F.col("o_month")).between(0, 3)
    by_value = exact(heads.where("net_c > 0").join(targets, same & (F.col("net_c") == F.col("o_net_c"))))
    period = lambda c: F.floor(F.col(c) / PERIOD)
    of_goods = heads.drop("codes", "near").where("supplier_key <> ''").withColumns({"k": F.col("supplier_key"), "g": F.explode(F.array_distinct(F.flatten("lines")))}).withColumn("p", F.explode(F.array(period("month"), period("month") - 1)))
    with_goods = targets.drop("o_codes").withColumns({"k": F.col("o_supplier_key"), "g": F.explode("goods"), "p": period("o_month")})
    by_goods = exact(of_goods.join(with_goods.hint("merge"), ["k", "g", "p"]).where(in_months))
    # An order of the supplier without such goods has nothing of its lines; without a value it can't come to so much.
    plain = heads.drop("lines", "codes", "near", "n")
    if least > WEIGHTS["supplier"] + WEIGHTS["time"] + 1e-6:
        plain = plain.where("net_c <> 0")
    months = plain.where("supplier_key <> ''").withColumns({"k": F.col("supplier_key"), "o_month": F.explode(F.sequence(F.col("month") - 3, "month"))})
    by_month = kept(months.join(targets.drop("goods", "o_codes").withColumn("k", F.col("o_supplier_key")).hint("merge"), ["k", "o_month"]), score(F.lit(1.0), F.lit(0.0)))
    first = cut(top(reduce(DataFrame.unionByName, [by_value, by_goods, by_month])))
    # An order with a code of the document must come to the best of these; another supplier's needs a value near the
    # document's. Only those that may are compared by their lines.
    bound = F.greatest(F.lit(least), F.coalesce(F.shiftright("top", RANK_BITS) / MILLION, F.lit(0.0)))
    coded = heads.join(first, "doc_id", "left").select("doc_id", "supplier_key", "net_c", "day", "near", bound.alias("bound"), F.explode("codes").alias("c"))
    coded = coded.join(targets.select("rank", "o_supplier_key", "o_net_c", "o_day", F.explode("o_codes").alias("c")).hint("merge"), "c")
    by_supplier = F.coalesce(F.array_contains("near", F.col("o_supplier_key")), F.lit(False)) & (score(F.lit(1.0), F.lit(1.0)) >= F.col("bound"))
    by_worth = (net != 0) & (o_net != 0) & (score(F.lit(_sure(least)), F.lit(1.0)) >= F.col("bound") - 2e-6)
    chance = coded.where(by_supplier | by_worth).where(score(suppliers, F.lit(1.0)) >= F.col("bound")).select("doc_id", "rank")
    by_code = exact(chance.join(heads.drop("codes", "near"), "doc_id").join(targets.drop("o_codes"), "rank"))
    best = top(first.unionByName(by_code)).select("doc_id", (RANKS - 1 - F.pmod("top", F.lit(RANKS))).alias("rank"), (F.shiftright("top", RANK_BITS) / MILLION).alias("score"))
    return best.join(targets.select("rank", "po"), "rank").select("doc_id", "po", "score")


#: A score in millionths and a rank are packed in one number, whose maximum needs no sorting.
MILLION, RANK_BITS, RANK_PARTS = 1_000_000, 42, 1 << 10
RANKS = 1 << RANK_BITS


def _ranked(targets: DataFrame) -> DataFrame:
    """``targets`` with rank: under ``RANKS``, in the order of po."""
    at = targets.repartitionByRange(min(RANK_PARTS, default_partitions(targets.sparkSession)), "po").sortWithinPartitions("po").withColumn("at", F.monotonically_increasing_id())
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return at.withColumn("rank", part * (RANKS // RANK_PARTS) + row).drop("at")


def balances(invoices: DataFrame, credits: DataFrame, payments: DataFrame) -> DataFrame:
    """(doc_id, number, total_c, credited_c, paid_c, open_c) of the invoices with more than nothing left.

    ``invoices``: doc_id, number, total_c; ``credits`` and ``payments``: number, amount_c. Both are summed per number before
    they meet the invoices; nobody checks whose they are, a number is enough; overpaid invoices are left out.
    """
    sums = lambda d, name: d.where("number is not null").groupBy("number").agg(F.sum("amount_c").cast("bigint").alias(name))
    out = invoices.join(sums(credits, "credited_c"), "number", "left").join(sums(payments, "paid_c"), "number", "left").na.fill(0, ["credited_c", "paid_c"])
    out = out.withColumn("open_c", (F.col("total_c") - F.col("credited_c") - F.col("paid_c")).cast("bigint"))
    return out.where("open_c > 0").select("doc_id", "number", "total_c", "credited_c", "paid_c", "open_c")
