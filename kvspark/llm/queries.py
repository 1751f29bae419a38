"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import chat, decontaminate, language, licences, lmscore, mainhtml, mixing, prefixhash, simhash, warc
from .common import table


def op1_decontaminate(spark, sf_dir):
    return decontaminate.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_warc(spark, sf_dir):
    return warc.query(table(spark, sf_dir, "pages"))


def op3_chat(spark, sf_dir):
    return chat.query(table(spark, sf_dir, "conversations"))


def op4_mainhtml(spark, sf_dir):
    return mainhtml.query(table(spark, sf_dir, "pages"))


def op5_mixing(spark, sf_dir):
    return mixing.query(table(spark, sf_dir, "documents"))


def op9_prefixhash(spark, sf_dir):
    return prefixhash.query(table(spark, sf_dir, "documents"))


def op10_simhash(spark, sf_dir):
    return simhash.query(table(spark, sf_dir, "documents"))


def op6_licences(spark, sf_dir):
    return licences.query(table(spark, sf_dir, "documents"))


def op7_lmscore(spark, sf_dir):
    return lmscore.query(table(spark, sf_dir, "documents"))


def op8_language(spark, sf_dir):
    return language.query(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_warc, op3_chat, op4_mainhtml, op5_mixing, op6_licences, op7_lmscore, op8_language, op9_prefixhash, op10_simhash)}

SQL = {
    "op1_decontaminate": decontaminate.SQL.replace("{docs}", "documents"),
    "op2_warc": warc.SQL,
    "op3_chat": chat.SQL,
    "op5_mixing": mixing.SQL.replace("{docs}", "documents"),
    "op6_licences": licences.SQL,
}
