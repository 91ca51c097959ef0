"""Contexts, sources, chat histories and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Wordings that requests and answers hold.
NO_HITS = "검색된 관련 문서가 없습니다. 이전 대화 문맥을 참고하여 답변하세요."
NO_TITLE = "제목 없음"
SYSTEM = "당신은 RAG 챗봇입니다. 답변은 반드시 한국어로, 제공되는 참고 문서를 바탕으로 객관적이고 명확하게 답변하십시오."
FOOTER = "\n\n**[출처]**\n"
HISTORY = 2


def contexts(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, context): documents in rank order, empty ones left out; a fixed sentence without hits."""
    lists = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("fused_rank", "document"))).alias("hits"))
    texts = F.filter(F.transform("hits", lambda h: h["document"]), lambda d: d != "")
    return queries.select("query_id").join(lists, "query_id", "left").select("query_id", F.when(F.col("hits").isNull(), NO_HITS).otherwise(F.array_join(texts, "\n---\n")).alias("context"))


def source_titles(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, titles): distinct titles, sorted; hits without a stored chunk have none, a chunk without a title a fixed one."""
    titles = F.sort_array(F.collect_set(F.when(F.col("page_id").isNotNull(), F.coalesce("title", F.lit(NO_TITLE)))))
    return queries.select("query_id").join(hits.groupBy("query_id").agg(titles.alias("titles")), "query_id", "left").withColumn("titles", F.coalesce("titles", F.array().cast("array<string>")))


def histories(messages: DataFrame, before: int = HISTORY) -> DataFrame:
    """messages(conv_id, turn, role, text) with `history`: the messages just before each, oldest first."""
    earlier = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-before, -1)
    return messages.withColumn("history", F.collect_list(F.struct("role", F.col("text").alias("content"))).over(earlier))


def augmented(context: Column, question: Column) -> Column:
    return F.concat(F.lit("[참고 문서]\n"), context, F.lit("\n\n[질문]\n"), question)


def requests(questions: DataFrame, model: str = "chat-model", temperature: float = 0.2, max_tokens: int = 1024) -> DataFrame:
    """(query_id, messages, payload) from questions(query_id, text, history, context)."""
    message = lambda role, content: F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))
    messages = F.concat(message("system", F.lit(SYSTEM)), F.col("history"), message("user", augmented(F.col("context"), F.col("text"))))
    payload = F.to_json(F.struct(F.lit(model).alias("model"), F.col("messages"), F.lit(False).alias("stream"), F.lit(temperature).alias("temperature"), F.lit(max_tokens).alias("max_tokens")))
    return questions.select("query_id", messages.alias("messages")).withColumn("payload", payload)


def with_footer(answer: Column, titles: Column) -> Column:
    lines = F.array_join(F.transform(titles, lambda t: F.concat(F.lit("- "), t)), "\n")
    return F.when(F.size(titles) > 0, F.concat(answer, F.lit(FOOTER), lines)).otherwise(answer)
