"""Webhook bodies: one JSON document with a list of events per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from msgsieve.functions.hashing import stable_id
from msgsieve.sources import schemas


def text_events(bodies: DataFrame, body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """Message events with text content; other events and empty lists vanish.

    Works on a batch or a stream.  ``keep`` names columns of the body row to
    carry along.
    """
    parsed = F.from_json(F.col(body), schemas.WEBHOOK_BODY)
    event = F.col("event")
    return (
        bodies.select(*keep, F.md5(body).alias("_body_md5"), F.posexplode(parsed["events"]).alias("position", "event"))
        .where((event["type"] == "message") & (event["message"]["type"] == "text"))
        .select(
            *keep,
            "position",
            event["replyToken"].alias("reply_token"),
            event["source"]["userId"].alias("user_id"),
            event["message"]["text"].alias("text"),
            event_id(event, F.col("position"), F.col("_body_md5")).alias("message_id"),
        )
    )


def event_id(event: Column, position: Column, body_md5: Column) -> Column:
    """Id of an event, so a redelivered event keeps its id.

    The reply token tells events apart; without one the place in the body does.
    """
    token, user, text = event["replyToken"], event["source"]["userId"], event["message"]["text"]
    place = F.concat_ws("-", body_md5, position)
    return F.when(token.isNotNull(), stable_id(token, user, text)).otherwise(stable_id(place, user, text))
