"""News and text: lexicon sentiment, article and symbol scores, velocity, topics, transcripts; loads of news with labels."""

from ..functions.operator import operator

# fixed values: phrases of guidance
RISK = "risk loss decline uncertain verlust risque riesgo".split()
FORWARD = "expect outlook guidance will forecast wird prévoit espera".split()


#: Score of each document: hits of the lexicon, turned round when a negation stands within three words before.
SIGNED = """n as (select doc_id, pos, phrase, kind, count(case when kind = 'negation' then 1 end) over (partition by doc_id order by pos range between 3 preceding and 1 preceding) as negations from hits),
l as (select doc_id, pos, phrase, case when kind = 'positive' then 1 else -1 end * case when negations = 0 then 1 else -1 end as s from n where kind <> 'negation')"""
SCORED = f"""{SIGNED}, scores as (select doc_id, sum(s) as score, sum(case when s > 0 then 1 else 0 end) as pos, sum(case when s < 0 then 1 else 0 end) as neg from l group by doc_id)"""
ARTICLES = f"""{SCORED}, articles as (select documents.doc_id, source as symbol, lang, documents.doc_id as hour, cast(coalesce(score, 0) as double) as score, coalesce(pos, 0) as pos, coalesce(neg, 0) as neg, n_chars from documents left join scores on documents.doc_id = scores.doc_id)"""

OPERATORS = [
    operator("lexicon_score", "hits", "N1 lexicon score of each text with negation within three words before", f"""
with {SCORED} select doc_id, cast(score as bigint) as score, cast(pos as bigint) as positive, cast(neg as bigint) as negative from scores"""),
    operator("article_score", "hits documents", "N2 twice the score of the first ten words, the score of the text and half of that of words of eight letters or more", f"""
with {SIGNED}
select documents.doc_id, round(coalesce(sum(s * (case when pos < 10 then 2.0 else 0.0 end + 1 + case when length(phrase) >= 8 then .5 else 0.0 end)), 0.0), 4) as score from documents left join l on documents.doc_id = l.doc_id group by documents.doc_id"""),
    operator("entity_weight", "documents", "N4 weight of an article by how many symbols it is about: 1.5 for one, 1.2 up to three, .5 beyond", """
select doc_id, case when doc_id % 5 = 0 then 1 when doc_id % 5 < 3 then 3 else 7 end as symbols, case when doc_id % 5 = 0 then 1.5 when doc_id % 5 < 3 then 1.2 else .5 end as weight from documents"""),
    operator("symbol_sentiment", "hits documents", "N5 sentiment of each source weighed by a recency half-life and entity weight, with shares, buzz and a contradiction flag", f"""
with {ARTICLES}, a as (select max(hour) as now, greatest(12.0, least(168.0, (max(hour) - min(hour)) / 4.0)) as half from articles),
w as (select symbol, score, power(.5, (now - hour) / half) * case when doc_id % 5 = 0 then 1.5 when doc_id % 5 < 3 then 1.2 else .5 end as w, now - hour < 24 as fresh from articles cross join a),
g as (select symbol, sum(w * score) / sum(w) as mean, stddev_samp(score) as sd, count(*) as n, avg(case when score > 0 then 1.0 else 0.0 end) as pos, avg(case when score < 0 then 1.0 else 0.0 end) as neg, avg(case when fresh then score end) as day from w group by symbol)
select symbol, round(mean / nullif(sd, 0), 5) as z, round(100 * (exp(2 * mean / nullif(sd, 0)) - 1) / (exp(2 * mean / nullif(sd, 0)) + 1), 3) as score, cast(n as bigint) as articles, round(pos, 6) as positive, round(neg, 6) as negative, round(day - mean, 4) as momentum, pos > .3 and neg > .3 as contradictory from g"""),
    operator("sentiment_velocity", "hits documents", "N6 velocity and acceleration of each source's sentiment over its last points, and the shift between its halves", f"""
with {ARTICLES}, d as (select symbol, floor(hour / 24.0) as day, avg(score) as v from articles group by symbol, floor(hour / 24.0)), k as (select symbol, v, row_number() over (partition by symbol order by day) as i, row_number() over (partition by symbol order by day desc) as back, count(*) over (partition by symbol) as n from d),
g as (select symbol, max(n) as n, regr_slope(case when back <= greatest(2, least(5, floor(n / 2.0))) then v end, cast(i as double)) as velocity, regr_slope(case when back > greatest(2, least(5, floor(n / 2.0))) and back <= 2 * greatest(2, least(5, floor(n / 2.0))) then v end, cast(i as double)) as before,
    avg(case when i * 2 > n then v end) - avg(case when i * 2 <= n then v end) as shift from k group by symbol having max(n) >= 4)
select symbol, round(velocity, 5) as velocity, round(velocity - before, 5) as acceleration, round(shift, 5) as shift, case when velocity > .05 and velocity > before then 'accelerating up' when velocity > .05 then 'rising' when velocity < -.05 and velocity < before then 'accelerating down' when velocity < -.05 then 'falling' else 'stable' end as signal, round(least(1.0, n / 10.0), 4) as confidence from g"""),
    operator("sentiment_history", "hits documents", "N7 mean, least, largest and number of each source's article scores, and the trend of its halves beyond .1", f"""
with {ARTICLES}, k as (select *, row_number() over (partition by symbol order by hour, doc_id) * 2 > count(*) over (partition by symbol) as late from articles)
select symbol, round(avg(score), 5) as mean, min(score) as least, max(score) as largest, cast(count(*) as bigint) as articles, case when avg(case when late then score end) - avg(case when not late then score end) > .1 then 'improving' when avg(case when late then score end) - avg(case when not late then score end) < -.1 then 'worsening' else 'stable' end as trend from k group by symbol"""),
    operator("headline_sentiment", "hits documents", "N8 shares of positive, negative and neutral articles, buzz and the five strongest, by source and language", f"""
with {ARTICLES}, k as (select *, row_number() over (partition by symbol, lang order by abs(score) desc, doc_id) as place from articles)
select symbol, lang, cast(count(*) as bigint) as buzz, round(avg(case when score > 0 then 1.0 else 0.0 end), 6) as positive, round(avg(case when score < 0 then 1.0 else 0.0 end), 6) as negative, round(avg(case when score = 0 then 1.0 else 0.0 end), 6) as neutral, round(avg(case when place <= 5 then score end), 4) as strongest from k group by symbol, lang"""),
    operator("keyword_sentiment", "hits documents", "N9 share of positive over all keywords of each article, and its impact by age and length", f"""
with {ARTICLES}, latest as (select max(hour) as now from articles)
select doc_id, round((pos - neg) * 1.0 / nullif(pos + neg, 0), 6) as sentiment, round(case when now - hour < 24 then 1.0 when now - hour < 72 then .7 else .4 end * case when n_chars > 2000 then 1.0 else .6 end, 4) as impact from articles cross join latest"""),
    operator("news_signal", "hits documents", "N10 sentiment of each source weighed by impact and confidence, as a banded signal with its urgency", f"""
with {ARTICLES}, latest as (select max(hour) as now from articles), w as (select symbol, (pos - neg) * 1.0 / (pos + neg) as s, case when now - hour < 24 then 1.0 when now - hour < 72 then .7 else .4 end * least(1.0, (pos + neg) / 20.0) as w from articles cross join latest where pos + neg > 0),
g as (select symbol, sum(w * s) / sum(w) as s, sum(w) as w from w group by symbol)
select symbol, round(s, 5) as sentiment, case when s > .4 then 'strong buy' when s > .15 then 'buy' when s < -.4 then 'strong sell' when s < -.15 then 'sell' else 'hold' end as signal, case when w > 100 then 'high' when w > 20 then 'medium' else 'low' end as urgency from g"""),
    operator("topics", "words documents", "N11 ten most frequent words of four letters or more of each language, without those of over half of its documents", """
with w as (select lang, word, count(*) as n, count(distinct words.doc_id) as docs from words join documents on words.doc_id = documents.doc_id where length(word) >= 4 group by lang, word), t as (select lang, count(*) as docs from documents group by lang),
k as (select w.lang, word, n, row_number() over (partition by w.lang order by n desc, word) as place from w join t on w.lang = t.lang where w.docs * 2 <= t.docs)
select lang, cast(place as integer) as place, word, cast(n as bigint) as n from k where place <= 10"""),
    operator("transcript_tone", "documents", "N11, N12 forward and risk phrases of each text, guidance direction and topic flags", f"""
with x as (select doc_id, lower(coalesce(text, '')) as t from documents), c as (select doc_id, {" + ".join(f"case when contains(t, '{w}') then 1 else 0 end" for w in FORWARD)} as forward, {" + ".join(f"case when contains(t, '{w}') then 1 else 0 end" for w in RISK)} as risk,
    contains(t, 'insider') or contains(t, 'director') as insider, contains(t, 'dividend') as dividend, contains(t, 'earnings') or contains(t, 'eps') as earnings from x)
select doc_id, forward, risk, case when forward > risk then 'raised' when forward < risk then 'lowered' else 'kept' end as guidance, insider, dividend, earnings from c"""),
    operator("labelled_news", "documents bars", "S3 news with the change over five bars from the first bar at or after its day; null without enough bars", """
with c as (select symbol, min(ts) as first_ts from bars group by symbol), t as (select max(symbol) as top from bars), n as (select doc_id, doc_id % top + 1 as symbol, doc_id % 400 as day from documents cross join t), d as (select n.doc_id, n.symbol, n.day, c.first_ts from n join c on n.symbol = c.symbol),
b as (select symbol, ts, DAYS(ts, first_day) as day, close, close5 from (select bars.symbol, ts, close, lead(close, 5) over (partition by bars.symbol order by ts) as close5, min(ts) over (partition by bars.symbol) as first_day from bars) z),
u as (select symbol, day, 0 as is_bar, doc_id, cast(null as double) as change from d union all select symbol, day, 1 as is_bar, cast(null as bigint) as doc_id, 100 * (close5 / close - 1) as change from b),
g as (select *, sum(is_bar) over (partition by symbol order by day desc, is_bar desc rows between unbounded preceding and current row) as bar from u),
f as (select symbol, bar, max(case when is_bar = 1 then change end) as change, max(case when is_bar = 1 then day end) as bar_day from g group by symbol, bar)
select g.doc_id, g.symbol, bar_day, round(f.change, 5) as change_5 from g join f on g.symbol = f.symbol and g.bar = f.bar where g.is_bar = 0"""),
    operator("text_labels", "documents labels", "Q4, M4 texts of ten characters or more, each once, with a label: title and description", """
with x as (select documents.doc_id, text, quality, row_number() over (partition by text order by documents.doc_id) as k from documents join labels on documents.doc_id = labels.doc_id where length(text) >= 10 and quality is not null)
select doc_id, substring(text, 1, 40) as title, substring(text, 41, 200) as description, case when quality = 1 then 'up' else 'down' end as label from x where k = 1"""),
]
