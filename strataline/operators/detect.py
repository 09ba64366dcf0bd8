"""Source detection as ordered column expressions: what a source string can be, best guess first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The source types.
TYPES = ("youtube", "playlist", "audio", "paper", "book", "article", "repo", "docs", "notes", "document", "thread", "transcript")

#: File endings by kind.
MEDIA = ("mp3", "m4a", "m4b", "aac", "wav", "flac", "ogg", "oga", "opus", "webm", "mp4", "m4v", "mov", "mkv")
OFFICE = ("docx", "pptx", "odt", "odp", "doc", "ppt", "rtf")
SUBTITLES = ("srt", "vtt")

#: Address patterns by kind; all match from the start.
HTTP = r"^https?://"
WATCH = r"^(https?://)?(www\.|m\.|music\.)?youtube\.com/watch\?"
VIDEO = r"^(https?://)?(youtu\.be/|(www\.|m\.|music\.)?youtube\.com/(watch\?|shorts/|live/))"
CHANNEL = r"(?i)^(https?://)?(www\.|m\.)?youtube\.com/(@[\w.-]+|channel/[\w-]+|c/[\w.-]+|user/[\w.-]+)(/[\w-]*)?/?([?#].*)?$"
PLAYLIST = r"^(https?://)?(www\.|m\.|music\.)?youtube\.com/playlist\?([^#]*&)?list="
LLMS = r"(?i)^https?://[^?#]*/llms(-full)?\.txt/?([?#].*)?$"
FEED = r"(?i)^https?://(feeds?\.[^/?#]+/[^?#]*|[^?#]*(\.rss|\.xml|/feed|/rss))/?([?#].*)?$"
PODCAST = r"(?i)^(https?://)?podcasts\.apple\.com/"
ARXIV = r"^(https?://)?(www\.)?arxiv\.org/(abs|pdf)/(\d{4}\.\d{4,5}(v\d+)?)"
REPO = r"(?i)^(https?://)?(www\.)?github\.com/([A-Za-z0-9][A-Za-z0-9-]*)/([A-Za-z0-9._-]+)/?([?#].*)?$"
HN = r"(?i)^https?://news\.ycombinator\.com/item\?([^#]*&)?id=(\d+)"
REDDIT = r"(?i)^https?://((www|old|new|np|m|i)\.)?reddit\.com/(r/[\w-]+/)?comments/([a-z0-9]+)"
REDDIT_SHORT = r"(?i)^https?://redd\.it/([a-z0-9]+)/?([?#].*)?$"


def _ends(column: Column, endings: tuple[str, ...]) -> Column:
    return F.lower(column).rlike(r"\.(" + "|".join(endings) + ")$")


def is_media(source: Column) -> Column:
    """Ends in an audio or video extension; only web addresses lose query and fragment first."""
    path = F.when(source.rlike("(?i)^https?://"), F.regexp_replace(source, r"[?#].*$", "")).otherwise(source)
    return _ends(path, MEDIA)


def possible_types(source: Column, is_folder: Column | None = None) -> Column:
    """The types a source can be, best guess first; empty if none."""
    http = source.rlike(HTTP)
    listed = source.rlike(r"[?&]list=")

    def types(*own: str) -> Column:
        rest = F.array(*[F.lit(t) for t in ("article", "audio") if t not in own])
        first = F.array(*[F.lit(t) for t in own])
        return F.when(http, F.concat(first, rest)).otherwise(first)

    chain = (
        F.when(source.rlike(WATCH) & listed & ~source.rlike(r"[?&]v="), types("playlist"))
        .when(source.rlike(VIDEO) & listed, types("youtube", "playlist"))
        .when(source.rlike(VIDEO), types("youtube"))
        .when(source.rlike(CHANNEL) | source.rlike(PLAYLIST), types("playlist"))
        .when(http & source.rlike(LLMS), types("docs"))
        .when(http & source.rlike(FEED), types("playlist"))
        .when(http & (source.rlike(PODCAST) | is_media(source)), types("audio"))
        .when(source.rlike(ARXIV), types("paper"))
        .when(source.rlike(REPO), types("repo"))
        .when(source.rlike(HN) | source.rlike(REDDIT) | source.rlike(REDDIT_SHORT), types("thread"))
        .when(http, F.array(F.lit("article"), F.lit("audio"), F.lit("docs")))
    )
    if is_folder is not None:
        chain = chain.when(is_folder, F.array(F.lit("notes")))
    return (
        chain.when(_ends(source, ("pdf",)), F.array(F.lit("paper"), F.lit("book")))
        .when(_ends(source, ("epub",)), F.array(F.lit("book")))
        .when(is_media(source), F.array(F.lit("audio")))
        .when(_ends(source, OFFICE), F.array(F.lit("document")))
        .when(_ends(source, SUBTITLES), F.array(F.lit("transcript")))
        .otherwise(F.array().cast("array<string>"))
    )


def detect(sources: DataFrame, source: str = "source", forced: str | None = None, is_folder: str | None = None) -> DataFrame:
    """Adds possible, source_type (null if refused) and reason (null if accepted)."""
    own = sources.withColumn("possible", possible_types(F.col(source), F.col(is_folder) if is_folder else None))
    want = F.col(forced) if forced else F.lit(None).cast("string")
    reason = (
        F.when(want.isNotNull() & ~want.isin(*TYPES), F.concat(F.lit("unknown source type: "), want))
        .when(F.size("possible") == 0, F.lit("unsupported source"))
        .when(want.isNotNull() & ~F.array_contains("possible", want), F.concat(F.lit("cannot be extracted as "), want))
    )
    return own.withColumn("reason", reason).withColumn("source_type", F.when(F.col("reason").isNull(), F.coalesce(want, F.element_at(F.col("possible"), F.when(F.size("possible") > 0, F.lit(1))))))


def arxiv_id(source: Column) -> Column:
    return F.nullif(F.regexp_extract(source, ARXIV, 4), F.lit(""))


def repository(source: Column) -> Column:
    """owner and repo, without a .git ending; null fields if it is no repository address."""
    return F.struct(F.nullif(F.regexp_extract(source, REPO, 3), F.lit("")).alias("owner"), F.nullif(F.regexp_replace(F.regexp_extract(source, REPO, 4), r"\.git$", ""), F.lit("")).alias("repo"))


def channel_videos_url(source: Column) -> Column:
    """A channel's listing of uploads, whatever tab of it was named."""
    own = F.substring(source, F.lit(1), F.instr(F.lower(source), "youtube.com/") + F.length(F.lit("youtube.com/")) + F.length(F.regexp_extract(source, CHANNEL, 3)) - 1)
    return F.when(source.rlike(CHANNEL), F.concat(F.when(source.rlike(HTTP), F.lit("")).otherwise(F.lit("https://")), own, F.lit("/videos")))


def thread_id(source: Column) -> Column:
    """platform and id of a discussion thread."""
    platform = F.when(source.rlike(HN), F.lit("hackernews")).when(source.rlike(REDDIT) | source.rlike(REDDIT_SHORT), F.lit("reddit"))
    own = F.when(source.rlike(HN), F.regexp_extract(source, HN, 2)).when(source.rlike(REDDIT), F.regexp_extract(source, REDDIT, 4)).when(source.rlike(REDDIT_SHORT), F.regexp_extract(source, REDDIT_SHORT, 1))
    return F.struct(platform.alias("platform"), own.alias("id"))


def default_limit(source: Column, limit: Column) -> Column:
    """Items of a listing: as asked for, else 20 of a channel, 5 of a feed, all of a playlist."""
    return F.coalesce(limit, F.when(source.rlike(CHANNEL), F.lit(20)).when(source.rlike(FEED), F.lit(5)))


def option_error(source_type: Column, limit: Column, transcribe: Column) -> Column:
    """Why an option does not apply to a type; null if all apply."""
    return F.when((limit < 1), F.lit("limit must be at least 1")).when(limit.isNotNull() & (source_type != "playlist"), F.lit("limit applies to playlists only")).when(
        transcribe & ~source_type.isin("youtube", "playlist"), F.lit("transcribe applies to videos and playlists only")
    )


def hint(error: Column) -> Column:
    """What a user can do about a fetch error."""
    return (
        F.when(error.contains("429") | error.contains("Too Many Requests"), F.lit("rate limited: wait and retry"))
        .when(F.lower(error).contains("confirm you") & F.lower(error).contains("bot"), F.lit("bot check: retry later or from another network"))
        .otherwise(F.lit("check the source and retry"))
    )


def home_redacted(path: Column, home: str) -> Column:
    """The path with the home folder, itself included, as ``~``."""
    return F.when(path == home, F.lit("~")).when(F.startswith(path, F.lit(home + "/")), F.concat(F.lit("~"), F.substring(path, F.lit(len(home) + 1), F.length(path)))).otherwise(path)
