"""The small labelled table of ``html_text``: pages written for it, and for each
text block in page order ``+`` (article) or ``-`` (not)."""

_S = "The river rose again on Tuesday and the lower fields were under water by the evening, as they had been in spring."
_L = ("Farmers who had moved their herds in time said that the warning had come early enough. Others had waited for the "
      "second call, which never came, and spent the night on the road with whatever they could carry in two trips.")
_T = "Waters rise"
_AD = "Buy two boots and get one more pair for free, only this week in all our shops in town and online."
_C = "I live close by and can say that it was much worse than you write here, nobody came to help us for two whole days."
_N = "We use cookies to make this site better for you. By going on you accept this, see our policy for more about it."

LABELLED_PAGES = [
    # menu, advert, article, footer
    (f"<nav><ul><li><a>Home</a></li><li><a>News</a></li><li><a>Sport</a></li></ul></nav><div class=ad>{_AD}</div>"
     f"<article><h1>{_T}</h1><p>{_S}</p><p>{_L}</p><p>Yes.</p></article><footer>&copy; The Paper</footer>", "----++++-"),
    (f"<header><div class=logo>The Paper</div><p>{_S}</p></header><main><h1>{_T}</h1><p>{_L}</p><p>{_S}</p></main>"
     f"<footer><p>{_L}</p><a>Contact</a></footer>", "--+++--"),
    # an article cut by adverts and notices
    (f"<article><header><h1>{_T}</h1></header><p>{_S}</p><div class=ad>Shoes!</div><p>{_L}</p><div class='sponsored'>{_AD}"
     f"</div><p>So it was.</p><aside>{_S}</aside><p>{_L}</p></article>", "++-+-+-+"),
    (f"<div id=cookie-notice><p>{_N}</p><p>OK</p></div><article><p>Short.</p><p>{_L}</p><div class='newsletter'>{_N}</div>"
     f"<p>No.</p></article>", "--++-+"),
    # comments after and inside the article
    (f"<article><h2>{_T}</h2><p>{_S}</p><p>End.</p></article><section id=comments><h3>Comments</h3><p>{_C}</p><p>{_C}</p>"
     f"<p>Right!</p></section><form><label>Your comment</label><p>{_N}</p></form>", "+++------"),
    (f"<main><article><p>{_L}</p><p>{_S}</p><div class=comments><div class=comment>{_C}</div><div class=comment>{_C} {_C}"
     f"</div></div></article></main>", "++--"),
    (f"<article><p>{_S}</p></article><section class=comments><article><p>{_C}</p></article></section>", "+-"),
    # side bars, related links
    (f"<div class=sidebar><h3>Most read</h3><p>{_S}</p><a>{_T}</a></div><article><p>{_L}</p><ul><li>One.</li><li>Two and "
     f"three.</li></ul><ul class=related><li><a>{_T}</a></li><li><a>More</a></li></ul></article><aside><p>{_L}</p></aside>",
     "---+++---"),
    (f"<article><h1>{_T}</h1><p>{_S} <a>more</a></p><p><a>A link alone</a></p><p>{_L}</p></article><div class=share><a>"
     f"Share</a></div>", "++++-"),
    # no article element
    (f"<div><a>Home</a> <a>News</a></div><div><h1>{_T}</h1><p>{_L}</p><p>{_S}</p><p>{_L}</p></div><div><a>About</a></div>"
     f"<div>&copy; 2001</div>", "-++++--"),
    (f"<table><tr><td><a>Home</a></td><td><a>Shop</a></td></tr></table><p>{_S}</p><p>{_L}</p><p>{_S}</p><div class=ads>"
     f"{_AD}</div><p>{_L}</p><div><a>Terms</a> <a>Help</a></div>", "--+++-+-"),
    (f"<div class=content><h2>{_T}</h2><p>{_S}</p><p>Hm.</p><p>{_L}</p></div><div class=footer><p>{_L}</p></div>"
     f"<div class='site-menu'><a>Up</a></div>", "++++--"),
    (f"<div class='post-body'><p>{_S}</p><blockquote>{_L}</blockquote><pre>a b c</pre></div><div class=popup>{_N}</div>"
     f"<div class=banner><a>{_AD}</a></div>", "+++--"),
    # forms and hidden parts around and in an article
    (f"<form><p>{_S}</p><p>Name</p><p>{_N}</p></form><article><p>{_S}</p><form><p>{_N}</p></form><p>Well.</p><div hidden>"
     f"{_L}</div></article><div class=legal>{_L}</div>", "---+-+--"),
    (f"<nav><p>{_L}</p><p>{_S}</p></nav><article><p>{_L}</p></article><nav><a>Next</a></nav>", "--+-"),
    (f"<p>{_L}</p><p>{_S}</p><p>{_L}</p>", "+++"),
    (f"<article><p>A.</p></article>", "+"),
    (f"<article><h1>{_T}</h1></article><footer>{_T}</footer>", "+-"),
    (f"<div><a>Home</a></div><div><a>One</a> <a>Two</a></div><p>{_S}</p><div><a>Three</a></div>", "--+-"),
    # long adverts, notices, comments and bars beside paragraphs without an article element
    (f"<div class=ad><p>{_L}</p></div><p>{_S}</p><p>{_L}</p><div class=advert>{_L} {_AD}</div><p>{_S}</p>", "-++-+"),
    (f"<h1>{_T}</h1><p>{_L}</p><div class='ad-slot'>{_S} {_AD}</div><p>{_S}</p><div class=comments><p>{_C}</p><p>{_L}</p></div>",
     "++-+--"),
    (f"<div class=consent>{_L}</div><p>{_S}</p><p>{_L}</p><div class=sidebar><p>{_L}</p></div><div class=promo>{_L}</div>",
     "-++--"),
    (f"<form><p>{_L}</p></form><p>{_L}</p><p>{_S}</p><aside><p>{_S}</p></aside><div class=banner>{_S} {_S}</div>", "-++--"),
    # short blocks before long ones: in heads, bars, notices and forms, and as headings and short paragraphs
    (f"<header><h1>The Paper</h1><p>{_L}</p></header><main><h1>{_T}</h1><p>{_L}</p></main>", "--++"),
    (f"<div class=header><p>The Paper</p><p>{_L}</p></div><h1>{_T}</h1><p>{_L}</p><p>{_S}</p>", "--+++"),
    (f"<aside><h3>Most read</h3><p>{_L}</p></aside><h1>{_T}</h1><p>{_L}</p><div class=sidebar><h3>More</h3><p>{_L}</p></div>",
     "--++--"),
    (f"<h2>{_T}</h2><p>{_L}</p><div class=comments><h3>Comments</h3><p>{_L}</p></div><form><p>Write</p><p>{_L}</p></form>",
     "++----"),
    (f"<div class=cookie><p>Cookies</p><p>{_L}</p></div><p>{_L}</p><p>Hm.</p><p>{_L}</p><div class=ad><b>Now!</b><p>{_L}</p></div>",
     "--+++--"),
    (f"<div class=advert><p>Boots</p><p>{_L}</p></div><h1>{_T}</h1><p>{_L}</p><p>Yes, he said.</p><p>{_L}</p><p>End</p>"
     f"<div><a>Home</a></div>", "--++++--"),
    (f"<nav><p>Go on</p><p>{_L}</p></nav><h1>{_T}</h1><h2>Under water</h2><p>{_L}</p><h2>Later</h2><p>{_L}</p>", "--+++++"),
    # blocks of links: beside paragraphs and an article (not text), in an article (text)
    (f"<div><a>All the news of today in one place</a></div><div><a>Our ten best stories</a></div><article><p><a>Here</a></p>"
     f"<p>{_L}</p><p><a>See this</a></p><p><a>The whole report of the town's office</a></p></article><div><a>Write to all of us now</a>"
     f"</div>", "--++++-"),
    (f"<div><a>All news</a></div><p><a>The five best places for a walk</a></p><p>{_L}</p><p>{_S}</p><p><a>What others have read "
     f"on this page</a></p><div><a>Ten more stories from the same town</a></div>", "--++--"),
    (f"<article><h2><a>{_T}</a></h2><p>{_L}</p><ul><li><a>One</a></li><li><a>Two of them</a></li></ul></article>", "++++"),
    (f"<div>Log in</div><div>Search</div><h1>{_T}</h1><p>{_L}</p><p>{_L}</p><div>All rights reserved</div>", "--+++-"),
]
