"""Declared schemas of every table; nothing is inferred at read time."""

from pyspark.sql import types as T


def _schema(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_long, _int, _double = T.LongType(), T.IntegerType(), T.DoubleType()
_string, _boolean = T.StringType(), T.BooleanType()

REVIEW_FILE = _schema(app_id=_long, app_name=_string, review_text=_string, positive=_int)

GAME = T.StructType(
    [
        T.StructField("app_id", _long),
        T.StructField("name", _string),
        T.StructField("start_date", _long),
        T.StructField("end_date", _long),
    ]
)
REGISTRY_FILE = _schema(training_games=T.ArrayType(GAME), validation_games=T.ArrayType(GAME))

GAME_METADATA = _schema(
    app_id=_long,
    app_name=_string,
    developer=_string,
    publisher=_string,
    release_date=_string,
    current_price_usd=_double,
    genres=_string,
    categories=_string,
    platforms=_string,
    required_age=_int,
    short_description=_string,
)

SUCCESS_METRICS = _schema(
    app_id=_long,
    app_name=_string,
    collection_date=_string,
    steamspy_owners_min=_long,
    steamspy_owners_max=_long,
    steamspy_players_forever=_long,
    steamspy_avg_playtime=_long,
    steamspy_positive=_long,
    steamspy_negative=_long,
    steam_metacritic_score=_long,
    steam_total_reviews=_long,
    steam_release_date=_string,
    steam_current_price_usd=_double,
    steamspy_genre=_string,
    steamspy_tags=_string,
    steamspy_languages=_string,
    estimated_revenue_usd=_double,
    success_tier=_string,
    data_complete=_boolean,
    last_error=_string,
)

SOURCE_RECORD = _schema(
    app_id=_long,
    app_name=_string,
    text=_string,
    sentiment_source=_string,
    timestamp=_string,
    is_pre_release=_boolean,
    author_type=_string,
    source_url=_string,
)

PREVIEW_ARTICLE = _schema(
    app_id=_long, app_name=_string, source_url=_string, publication=_string, date=_string, text=_string
)

TRAINING_RESULT = _schema(
    model=_string,
    type=_string,
    seed=_long,
    fold=_int,
    f1_score=_double,
    accuracy=_double,
    precision=_double,
    recall=_double,
    train_time=_double,
    inference_time_ms=_double,
    timestamp=_string,
    tp=_long,
    tn=_long,
    fp=_long,
    fn=_long,
)

# Store page document: nested developers, prices, genres, platforms.
_described = T.ArrayType(_schema(description=_string))
STORE_JSON = _schema(
    developers=T.ArrayType(_string),
    publishers=T.ArrayType(_string),
    release_date=_schema(date=_string),
    price_overview=T.MapType(_string, _string),
    is_free=_boolean,
    genres=_described,
    categories=_described,
    platforms=T.MapType(_string, _boolean),
    required_age=_string,
    short_description=_string,
    metacritic=_schema(score=_long),
    recommendations=_schema(total=_long),
)

# Engagement document: owner range, counts and a name -> votes map of tags.
ENGAGEMENT_JSON = _schema(
    owners=_string,
    players_forever=_long,
    average_forever=_long,
    positive=_long,
    negative=_long,
    genre=_string,
    languages=_string,
    tags=T.MapType(_string, _long),
)

CANDIDATE_JSON = _schema(name=_string, positive=_long, negative=_long, owners=_string)
