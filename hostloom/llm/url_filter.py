"""URL filters: rules by host and path, and a logistic regression on hashed character n-grams.

The regression is trained on a small table of labelled URLs, below, once on the driver; its weights go to the
tasks. A URL's features are the n-grams of three to five bytes of its host and path, hashed into a fixed
table, each host n-gram apart from the same one in the path. The host is framed by dots, so that an n-gram tells
whether it begins or ends a label; "www" says nothing and is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import text_buffers

#: verdict, host, path
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DIMENSIONS, GRAMS = 1 << 16, (3, 4, 5)
STEPS, RATE, DECAY = 400, 0.5, 0.002
#: The labelled table: made-up sites of the kinds that are to be blocked, and sites that aren't, many of which share letters with them.
BLOCKED = """
casino-royale-online.com/slots royalcasino.net/jackpot bestcasinobonus.com/free-spins playcasino24.eu/ megacasino.org/win vegas-slots-online.com/play freeslots777.com/ slotmachines-free.net/bonus
jackpot-city-games.com/ luckyjackpot.biz/spin onlinepoker-room.com/deposit pokerstars-bonus.net/ texas-poker-free.com/ sportsbetting-tips.com/odds betting-odds24.com/bet livebets.net/football bestbets-online.co/
bet-win-now.com/ gambling-guide.net/casino online-gambling.org/ lottery-winner.info/claim you-win-lottery.com/prize winbig-prizes.com/ win-free-iphone.com/claim claim-your-prize.net/winner
cheap-viagra-online.com/buy viagra-cialis-shop.net/order buycheapmeds.com/pills cheap-pills.biz/ pillsonline-noprescription.com/ diet-pills-discount.com/ pharmacy-cheap-pills.net/viagra weightloss-pills.info/buy
payday-loans-fast.com/apply quickpaydayloan.net/ loans-no-credit-check.com/ instant-cash-loans.org/ cheaploans24.com/apply-now badcredit-loans.info/ fast-cash-advance.com/
xxx-videos-free.com/watch freexxx.net/ hotsex-chat.com/live sexcams-live.net/ adult-dating-club.com/join adultvideos.org/xxx nude-girls-cam.com/ nudephotos.biz/ freeporn-tube.com/video pornhub-mirror.net/
best-porn-xxx.com/ escort-girls-city.com/ vip-escorts.net/ adult-toys-cheap.com/ sexy-singles.info/chat
replica-watches-cheap.com/rolex replicabags-outlet.net/ luxury-replica.org/buy cheap-handbags-outlet.com/ fakewatches-shop.net/
warez-downloads.net/crack free-warez.org/keygen crackedsoftware.info/serial keygen-crack-free.com/ warezforum.biz/ serials-cracks.net/download
click-ads-network.com/track adclick-tracker.net/ ads-tracking.com/click popup-ads.biz/ adserver-tracker.com/banner trackclicks.net/ads best-promo-deals.com/coupon promo-codes-free.net/ hotdeals-discount.com/buy-now cheap-deals24.com/
seo-backlinks-cheap.com/buy buy-backlinks-seo.net/ link-farm-seo.org/ spam-farm.info/ seospam.net/links spamlinks.biz/ rank-booster-seo.com/ articlespam-bot.com/ free-traffic-bot.net/clicks
get-rich-quick.biz/ make-money-fast.info/ work-from-home-cash.com/ free-gift-cards.net/claim free-bitcoin-bonus.com/ crypto-doubler.net/invest bonus-hunter.net/free
""".split()
ALLOWED = """
manchester.gov.uk/council chichester.ac.uk/study windsor.gov.uk/parks windows-docs.org/guide wintersports.ch/ski winterthur.ch/museum twinrivers.edu/library windpower.org/energy thewindmill.net/history baldwin.edu/
sussex.ac.uk/research essex.gov.uk/schools middlesex.edu/ wessexwater.co.uk/ sextant-navigation.org/ unisex-names.info/
farmland-trust.org/ organicfarm.coop/harvest farmersalmanac.net/weather windfarm-project.eu/ farmhouse-kitchen.com/recipes familyfarms.org/market fishmarket.no/ supermarket-news.com/ marketplace.org/radio
openbsd.org/faq netbsd.org/ports freelibrary.org/books freedom-museum.org/ freemansjournal.ie/ freeware-archive.net/unix freesoftware.org/licenses freeschool.edu/
lighthouse.org/ warehouse-tools.com/data coffeehouse.net/menu greenhouse-gardens.com/ housing.gov/ clicktraining.org/dogs clickable-maps.net/atlas databases.dev/docs
racetrack-history.com/ trackrecords.org/athletics fieldandtrack.net/club railtracks.info/ cricketfield.org/ athletics.org/results soundtrack-review.com/ backtracker.dev/code
mathlessons.edu/algebra mathematics.org/papers bonusround-books.com/reading mathclub.edu/courses bonuslessons.edu/algebra bonustracks-music.net/jazz bonus-malus-history.org/
adelaide.edu.au/ adsorption-science.org/ roads.gov/maps leadership.org/ heads-up.net/ pads.org/ uploads.wiki/images dads-club.org/ threads.dev/
better-health.gov/ betty-cooks.com/recipes alphabet-school.edu/ tibet-museum.org/ diabetes.org/care abetterworld.org/
pilsner-brewers.cz/ pillars-of-history.org/ spilled-ink.com/poems caterpillars.info/garden
loanword-dictionary.org/ loanlibrary.edu/books sloane-museum.org/ student-loans.gov/help
nudge-theory.org/papers nudibranch.info/ocean denuded-hills.org/ adulteducation.edu/courses adultliteracy.org/
escorted-tours.travel/italy cohorts-study.org/ resorts.travel/ comfort-homes.com/ ports.org/
promontory-park.org/ prominent-painters.com/ dealership-news.com/ idealist.org/jobs ideals.edu/ cheapside-street.co.uk/history
seoul.go.kr/ museo-nacional.es/arte museodelprado.es/ sequoia-park.org/ spanish-museum.es/ spamassassin.dev/docs
slotcar-racing.club/ timeslots.dev/api casinomuseum-architecture.org/ pokeweed-botany.org/ lotus.org/ lotteryhall-theatre.org/programme
luxurious-gardens.co.uk/ replicate-science.org/ replication.dev/docs warezones.edu/ software.org/ hardware-review.net/ wares-of-old.org/pottery
news.bbc.example/world daily-journal.com/politics cityweather.gov/today local-history.org/archive cooking-recipes.net/soup botanic-garden.org/plants university-press.edu/books travel-stories.com/asia science-magazine.org/physics
photography-school.com/lessons art-museum.org/visit music-archive.net/jazz chess-club.org/games bookshop.co.uk/fiction health-service.gov/vaccines national-library.org/catalogue research-institute.edu/papers bird-watching.org/species
opensource-project.org/download kernel.org/doc python-tutorial.dev/lists maps-atlas.net/rivers train-timetable.ch/zurich parliament.gov/bills court-records.gov/cases theatre-festival.org/programme village-school.org/news gardening-blog.com/roses
""".split()


#: Both labels are learnt under the same domains, in equal shares, so that a domain tells nothing.
DOMAINS = ("com", "org", "net", "example.com", "co.uk")


def labelled_urls() -> list[tuple[str, str, int]]:
    """host, path, 1 for a URL to block: the sites' names under each of DOMAINS."""
    out = []
    for label, urls in ((1, BLOCKED), (0, ALLOWED)):
        for url in urls:
            host, _, path = url.partition("/")
            out += [(f"{host.split('.')[0]}.{domain}", "/" + path, label) for domain in DOMAINS]
    return out


def features(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all n-grams, URL by URL, and the offsets of the URLs."""
    framed = pc.replace_substring_regex(pc.fill_null(hosts.cast(pa.string()), ""), r"^(www\.)?(.+)$", r".\2.")
    hosts = framed.combine_chunks() if isinstance(framed, pa.ChunkedArray) else framed
    parts, owner = [], []
    for side, column in enumerate((hosts, paths)):
        data, offsets = text_buffers(column)
        data = data[offsets[0] : offsets[-1]].astype(np.uint64)
        cuts = offsets - offsets[0]
        left = np.repeat(cuts[1:], np.diff(cuts)) - np.arange(len(data))  # bytes up to the URL's end
        url = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        for n in GRAMS:
            at = np.flatnonzero(left >= n)
            h = np.full(len(at), side * 8 + n, np.uint64)
            for k in range(n):
                h = h * np.uint64(0x100000001B3) + data[at + k]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            parts.append((h >> np.uint64(40)).astype(np.int64) % DIMENSIONS)
            owner.append(url[at])
    index, url = np.concatenate(parts), np.concatenate(owner)
    order = np.argsort(url, kind="stable")
    return index[order], np.searchsorted(url[order], np.arange(len(hosts) + 1))


def _logit(weights: np.ndarray, bias: float, index: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(weights[index])])
    return (sums[cuts[1:]] - sums[cuts[:-1]]) / np.sqrt(np.maximum(np.diff(cuts), 1)) + bias


def fit(urls: list[tuple[str, str, int]]) -> tuple[np.ndarray, float]:
    """Weights and bias after gradient descent on labelled URLs: host, path, label."""
    index, cuts = features(pa.array([u[0] for u in urls], pa.string()), pa.array([u[1] for u in urls], pa.string()))
    y, size = np.array([u[2] for u in urls], float), np.sqrt(np.maximum(np.diff(cuts), 1))
    weights, bias = np.zeros(DIMENSIONS), 0.0
    for _ in range(STEPS):
        gap = y - 1 / (1 + np.exp(-_logit(weights, bias, index, cuts)))
        weights += RATE * (np.bincount(index, np.repeat(gap / size, np.diff(cuts)), DIMENSIONS) - DECAY * weights)
        bias += RATE * gap.mean()
    return weights, bias


def scores(model: tuple[np.ndarray, float], hosts: pa.Array, paths: pa.Array) -> np.ndarray:
    index, cuts = features(hosts, paths)
    return 1 / (1 + np.exp(-_logit(*model, index, cuts)))


def _score(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores(sent.value, part.column(1), part.column(2)))], names=["page_id", "host", "path", "score"])

    return run


def parts(url):
    """Columns host and path of a URL."""
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] = RULES, threshold: float = 0.5, urls: list[tuple[str, str, int]] | None = None) -> DataFrame:
    """Per row of pages: page_id, host, path, rule, verdict, score.

    The longest rule that fits decides; without one, block if the regression's score is at the threshold or
    over it. A null URL or one without '://' has an empty host and path, fits no rule and has no n-gram:
    its score is that of the bias. urls: the labelled table to learn from (null: this module's). Repeated rows repeat their result; an empty table gives an empty one. Other columns
    are not read.
    """
    host, path = parts(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    sent = pages.sparkSession.sparkContext.broadcast(fit(labelled_urls() if urls is None else urls))  # DIMENSIONS numbers
    rows = rows.mapInArrow(_score(sent), "page_id long, host string, path string, score double")
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("score") >= threshold, "block").otherwise("allow")
    for said, of_host, of_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # a longer one overrides
        fits = ((F.col("host") == of_host) | F.col("host").endswith("." + of_host)) & F.col("path").startswith(of_path)
        rule, verdict = F.when(fits, of_host + of_path).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "score")


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
