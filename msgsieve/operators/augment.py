"""Generated messages from templates.

Every choice is a hash of (seed, row id, slot), so a row is the same however
the work is partitioned or retried.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from msgsieve import fixed_values as fixed
from msgsieve.functions.hashing import UINT32, hex_to_number, stable_id

TEMPLATES = [fixed.HAM_TEMPLATES, fixed.SPAM_TEMPLATES, fixed.PHISHING_TEMPLATES]
FIRST_DAY = "2023-01-01"
DAYS = 730


class Slots:
    """Numbered random draws of a row; four draws share one md5."""

    def __init__(self, seed: int, key: Column):
        self.seed, self.key, self.used = seed, key.cast("string"), 0

    def number(self) -> Column:
        """A fresh draw in [0, 2^32)."""
        block, position = divmod(self.used, 4)
        self.used += 1
        digest = F.md5(F.concat(F.lit(f"{self.seed}|{block}|"), self.key))
        return hex_to_number(digest, position)

    def choice(self, values: Sequence) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), (self.number() % len(values)).cast("int"))

    def integer(self, low: int, high: int) -> Column:
        return F.lit(low) + self.number() % (high - low + 1)

    def chance(self, probability: float) -> Column:
        return self.number() / F.lit(float(UINT32)) < probability


def template_values(draw: Slots) -> dict[str, Column]:
    """Values for the template variables, as text."""

    def text(value: Column) -> Column:
        return value.cast("string")

    def grouped(value: Column) -> Column:
        return F.format_number(value, 0)

    def day() -> Column:
        parts = [text(draw.integer(1, 28)), text(draw.integer(1, 12)), text(draw.integer(67, 68))]
        return F.concat_ws("/", *parts)

    price = draw.choice(fixed.COURSE_PRICES)
    return {
        "prize": grouped(draw.choice(fixed.PRIZES)),
        "discount": text(draw.choice(fixed.DISCOUNTS)),
        "profit": text(draw.choice(fixed.PROFITS)),
        "bank": draw.choice(fixed.BANKS),
        "location": draw.choice(fixed.LOCATIONS),
        "place": draw.choice(fixed.PLACES),
        "url": draw.choice(fixed.FAKE_URLS),
        "phone": draw.choice(fixed.FAKE_PHONES),
        "phone_short": F.concat(
            F.lit("0"), text(draw.integer(80, 99)), F.lit("-xxx-"), text(draw.integer(1000, 9999))
        ),
        "otp": draw.choice(fixed.FAKE_OTPS),
        "time": draw.choice(fixed.TIMES),
        "time2": draw.choice(fixed.TIMES),
        "nights": text(draw.integer(3, 7)),
        "bonus": grouped(draw.choice(fixed.PRIZES) * 2),
        "date": day(),
        "legit_url": draw.choice(fixed.LEGIT_URLS),
        "university": draw.choice(fixed.UNIVERSITIES),
        "course_name": draw.choice(fixed.COURSE_NAMES),
        "course_price": text(price),
        "course_price2": text(price + draw.choice([200, 300, 500])),
        "batch": text(draw.integer(1, 20)),
        "seats": text(draw.choice([20, 30, 40, 50, 60])),
        "year": text(draw.choice([2568, 2569])),
        "years": text(draw.integer(5, 30)),
        "date2": day(),
        "phone_real": draw.choice(fixed.REAL_PHONES),
    }


def fill_template(template: Column, values: Mapping[str, Column]) -> Column:
    """Substitute ``{name}``; a template with an unknown name stays as it is."""
    filled = template
    for name, value in values.items():
        filled = F.replace(filled, F.lit("{" + name + "}"), value)
    known = "|".join(values)
    unknown = template.rlike(rf"\{{(?!(?:{known})\}})[^{{}}]*\}}")
    return F.when(unknown, template).otherwise(filled)


def add_noise(text: Column, draw: Slots) -> Column:
    """Sometimes a prefix, sometimes a suffix, ends stripped."""
    prefix = F.when(draw.chance(0.3), draw.choice(fixed.NOISE_PREFIXES)).otherwise("")
    suffix = F.when(draw.chance(0.2), draw.choice(fixed.NOISE_SUFFIXES)).otherwise("")
    return F.trim(F.concat(prefix, text, suffix))


def messages_for(
    rows: DataFrame,
    key: str,
    label: str = "label",
    seed: int = 42,
    templates: Sequence[Sequence[str]] = tuple(TEMPLATES),
    source: str = "synthetic",
) -> DataFrame:
    """One generated message per row, of the row's label."""
    draw = Slots(seed, F.col(key))
    position = draw.number()
    template = F.lit(None).cast("string")
    for k, options in enumerate(templates):
        listed = F.array(*[F.lit(t) for t in options])
        picked = F.get(listed, (position % len(options)).cast("int"))
        template = F.when(F.col(label) == k, picked).otherwise(template)
    text = add_noise(fill_template(template, template_values(draw)), draw)
    created = F.date_add(F.to_date(F.lit(FIRST_DAY)), (draw.number() % (DAYS + 1)).cast("int"))
    names = F.array(*[F.lit(n) for n in fixed.LABELS])
    return rows.select(
        stable_id(F.lit(source), F.lit(seed), F.col(key)).alias("message_id"),
        text.alias("text"),
        F.col(label).cast("int").alias("label"),
        F.get(names, F.col(label).cast("int")).alias("label_name"),
        F.lit(source).alias("source"),
        F.date_format(created, "yyyy-MM-dd HH:mm:ss").alias("created_at"),
    )


def generate_corpus(
    spark: SparkSession, n_ham: int = 4500, n_spam: int = 2000, n_phishing: int = 1500, seed: int = 42
) -> DataFrame:
    """A corpus with the given number of messages per class."""
    ids = spark.range(n_ham + n_spam + n_phishing)
    label = F.when(F.col("id") < n_ham, 0).when(F.col("id") < n_ham + n_spam, 1).otherwise(2)
    return messages_for(ids.withColumn("label", label), "id", seed=seed)
