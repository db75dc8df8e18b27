"""A fetcher for the feed source's tests."""

import json


def fetch(ticker, start, end):
    return 200, json.dumps({"feed": [{"title": f"{ticker} {start}", "ticker_sentiment": [{"ticker": ticker, "relevance_score": "0.5"}]}]})
