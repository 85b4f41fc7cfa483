"""Sequential model of the event handlers: one event at a time, per-row upserts."""

from __future__ import annotations

import json

STAGES = ("link.added", "content.fetched", "enrichment.completed", "publish.completed", "link.visibility_changed")


class State:
    def __init__(self):
        self.links, self.content, self.meta, self.publish = {}, {}, {}, {}

    def apply(self, sid, kind, p, at, source="s"):
        if kind == "link.added":
            if p.get("url"):
                self.links.setdefault(
                    sid, {"url": p["url"], "source": source, "created_at": at, "status": "new", "visibility": "public",
                          "retry_count": 0, "last_error": None, "last_error_at": None})
            return
        if sid not in self.links:
            return  # the foreign key rejects the child row, updates hit nothing
        link = self.links[sid]
        if kind == "content.fetched":
            c = self.content.setdefault(sid, {k: None for k in ("final_url", "title", "text_content", "html_storage_key")})
            for k in ("final_url", "title", "text_content", "html_storage_key"):
                if p.get(k) is not None:
                    c[k] = p[k]
            c["fetched_at"], c["fetch_error"] = at, p.get("fetch_error")
            if p.get("fetch_error"):
                link.update(status="error", last_error=p["fetch_error"], last_error_at=at, retry_count=link["retry_count"] + 1)
            elif link["status"] == "new":
                link["status"] = "fetched"
        elif kind == "enrichment.completed":
            m = self.meta.setdefault(sid, {"tags": [], "summary_short": None, "summary_long": None, "language": None, "model_version": None})
            if p.get("tags"):
                m["tags"] = p["tags"]
            short = p.get("summary_short") if p.get("summary_short") is not None else p.get("summary")
            for k, v in (("summary_short", short), ("summary_long", p.get("summary_long")), ("language", p.get("language")),
                         ("model_version", p.get("model_version"))):
                if v is not None:
                    m[k] = v
            if link["status"] in ("new", "fetched"):
                link["status"] = "enriched"
            s = self.publish.setdefault(sid, {"desired_version": 0, "published_version": 0, "last_published_at": None})
            s["desired_version"] += 1
            s["dirty"] = True
        elif kind == "publish.completed":
            if sid in self.publish:
                s = self.publish[sid]
                s.update(published_version=s["desired_version"], dirty=False, last_published_at=at)
            link["status"] = "published"
        elif kind == "link.visibility_changed" and p.get("visibility") in ("public", "private"):
            link["visibility"] = p["visibility"]


def random_payload(rng, kind):
    def some(v):
        return v if rng.random() < 0.6 else None

    n = rng.randrange(100)
    if kind == "link.added":
        p = {"url": rng.choice([f"https://e.com/{n}", f"https://e.com/{n}", "", None])}
    elif kind == "content.fetched":
        p = {"final_url": some(f"f{n}"), "title": some(f"t{n}"), "text_content": some(f"x{n}"), "html_storage_key": some(f"h{n}"),
             "fetch_error": rng.choice([None, None, "", f"E{n}"])}
    elif kind == "enrichment.completed":
        p = {"tags": rng.choice([None, [], [f"a{n}"], [f"a{n}", f"b{n}"]]), "summary_short": some(f"s{n}"), "summary": some(f"o{n}"),
             "summary_long": some(f"l{n}"), "language": some("en"), "model_version": some(f"m{n}")}
    elif kind == "link.visibility_changed":
        p = {"visibility": rng.choice(["public", "private", "bogus"])}
    else:
        p = {}
    return {k: v for k, v in p.items() if v is not None}


def dumps(p):
    return json.dumps(p)
