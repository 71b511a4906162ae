"""Hand-written pages: (name, html, blocks to keep in order, blocks that must not appear)."""

P1 = "The council voted on Tuesday to widen the old bridge, which carries most of the traffic into town."
P2 = "Work will begin in spring and last for two years, the engineer in charge told the meeting."
P3 = "Residents had asked for a footpath on both sides, and the plan now has one."
NAV = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li><li><a href='/s'>Sport</a></li></ul></nav>"
FOOT = "<footer><p>Copyright 2024 The Paper</p><ul><li><a href='/a'>About</a></li></ul></footer>"
SIDE = "<aside class='sidebar'><h3>Most read</h3><ul><li><a href='/1'>A story</a></li><li><a href='/2'>Another one</a></li></ul></aside>"
AROUND = ["The Paper", "Home", "News", "Sport", "Copyright 2024 The Paper", "About", "Most read", "A story", "Another one"]
TITLE = "Bridge to be widened"


def page(body, extra=""):
    return f"<!doctype html><html><head><title>T</title></head><body><header class='site-header'><a href='/'>The Paper</a></header>{NAV}{body}{extra}{FOOT}</body></html>"


HAND_PAGES = [
    ("lists", page(f"<article><h1>{TITLE}</h1><p>{P1}</p><ul><li>A new deck</li><li>Two footpaths</li><li>Lamps on every pier</li></ul><p>{P2}</p><ol><li>Survey the piers</li><li>Close one lane</li></ol></article>", SIDE),
     [TITLE, P1, "A new deck", "Two footpaths", "Lamps on every pier", P2, "Survey the piers", "Close one lane"], []),
    ("code and quote", page(f"<article><h1>How to list files</h1><p>{P1}</p><pre><code>for f in *.txt; do echo $f; done</code></pre><p>{P2}</p><blockquote><p>{P3}</p></blockquote></article>"),
     ["How to list files", P1, "for f in *.txt; do echo $f; done", P2, P3], []),
    ("pre in main", page(f"<main><h1>How to list files</h1><p>{P1}</p><pre>ls -l /tmp</pre><p>{P2}</p></main>", SIDE), ["How to list files", P1, "ls -l /tmp", P2], []),
    ("table", page(f"<div id='content'><h1>Bridge figures</h1><p>{P1}</p><table><tr><th>Year</th><th>Cost</th></tr><tr><td>2024</td><td>12 million</td></tr><tr><td>2025</td><td>9 million</td></tr></table><p>{P2}</p></div>", SIDE),
     ["Bridge figures", P1, "Year", "Cost", "2024", "12 million", "2025", "9 million", P2], []),
    ("table with head", page(f"<article><h1>Bridge figures</h1><p>{P1}</p><table class='data'><thead><tr><th>Year</th><th>Cost</th></tr></thead><tbody><tr><td>2024</td><td>12 million</td></tr></tbody></table></article>"),
     ["Bridge figures", P1, "Year", "Cost", "2024", "12 million"], []),
    ("header in article", page(f"<article><header><h1>{TITLE}</h1><p class='byline'>By Ann Writer</p></header><p>{P1}</p><p>{P2}</p></article>", SIDE), [TITLE, "By Ann Writer", P1, P2], []),
    ("advert in main", page(f"<main><h1>{TITLE}</h1><p>{P1}</p><aside>Advert</aside><p>{P2}</p><div class='ad'>Buy two, get one free</div><p>{P3}</p></main>"), [TITLE, P1, P2, P3], ["Advert", "Buy two, get one free"]),
    ("caption", page(f"<article><h1>{TITLE}</h1><figure><img src='b.jpg'><figcaption>The bridge as it is today</figcaption></figure><p>{P1}</p><h2>What is planned</h2><p>{P2}</p></article>", SIDE),
     [TITLE, "The bridge as it is today", P1, "What is planned", P2], []),
    ("comments", page(f"<article><h1>{TITLE}</h1><p>{P1}</p><p>{P2}</p></article><section class='comments'><h2>Comments</h2><div class='comment'><p>I am against it.</p></div><div class='comment'><p>About time, I say!</p></div></section>"),
     [TITLE, P1, P2], ["Comments", "I am against it.", "About time, I say!"]),
    ("definitions", page(f"<main><article><h1>Words of the trade</h1><p>{P1}</p><dl><dt>Pier</dt><dd>What stands in the water and carries the deck</dd><dt>Deck</dt><dd>What the cars drive on</dd></dl></article></main>", SIDE),
     ["Words of the trade", P1, "Pier", "What stands in the water and carries the deck", "Deck", "What the cars drive on"], []),
    ("bare quote", page(f"<article><h1>{TITLE}</h1><p>{P1}</p><blockquote>{P2}</blockquote><p>{P3}</p></article>"), [TITLE, P1, P2, P3], []),
    ("plain divs", page(f"<div class='post'><h1>{TITLE}</h1><div>{P1}</div><div>{P2}</div><p>{P3}</p></div>", SIDE), [TITLE, P1, P2, P3], []),
    ("nested list", page(f"<div class='wrap'><section class='story'><h1>{TITLE}</h1><p>{P1}</p><ul><li>Cost<ul><li>steel</li><li>stone</li></ul></li><li>Time</li></ul><p>{P2}</p></section></div>", SIDE),
     [TITLE, P1, "Cost", "steel", "stone", "Time", P2], []),
    ("notice and form", page(f"<div class='cookie-notice'><p>We use cookies to make this site better.</p></div><main><h1>{TITLE}</h1><p>{P1}</p><p>{P2}</p></main><form class='newsletter'><label>Your mail</label><button>Sign up</button></form>"),
     [TITLE, P1, P2], ["We use cookies to make this site better.", "Your mail", "Sign up"]),
    ("two tables", page(f"<article><h1>Bridge figures</h1><p>{P1}</p><table><caption>Cost by year</caption><tr><td>2024</td><td>12</td></tr></table><p>{P2}</p><table><tr><td>Piers</td><td>7</td></tr><tr><td>Lamps</td><td>14</td></tr></table><p>{P3}</p></article>"),
     ["Bridge figures", P1, "Cost by year", "2024", "12", P2, "Piers", "7", "Lamps", "14", P3], []),
]
