"""Labelled URLs, 1 for unwanted: pages of well-known sites, and URLs made up by hand in the manner of link spam, fake shops, betting and phishing pages.

They come from no generator, so the share held out by ``split`` says how trees do on URLs that nobody drew from their training set's rules."""

from __future__ import annotations

import zlib

# One URL a line.
WANTED = """
https://en.wikipedia.org/wiki/Apache_Spark
https://de.wikipedia.org/wiki/Schmetterlinge
https://www.bbc.co.uk/news/science-environment-56837908
https://www.theguardian.com/books/2021/mar/04/the-best-recent-poetry
https://www.nytimes.com/2020/05/11/dining/bread-baking.html
https://www.nature.com/articles/s41586-020-2649-2
https://arxiv.org/abs/1706.03762
https://docs.python.org/3/library/itertools.html
https://spark.apache.org/docs/latest/sql-programming-guide.html
https://stackoverflow.com/questions/11227809/why-is-processing-a-sorted-array-faster
https://github.com/apache/arrow/blob/main/README.md
https://www.gutenberg.org/files/1342/1342-h/1342-h.htm
https://plato.stanford.edu/entries/descartes/
https://www.nasa.gov/missions/voyager-1/
https://www.who.int/news-room/fact-sheets/detail/malaria
https://www.britannica.com/place/Lake-Constance
https://www.lemonde.fr/planete/article/2021/06/01/les-oiseaux-des-champs_6082345_3244.html
https://www.spiegel.de/wissenschaft/natur/wale-und-delfine-a-1234567.html
https://elpais.com/cultura/2021/04/23/libros.html
https://www.allrecipes.com/recipe/20144/banana-banana-bread/
https://www.imdb.com/title/tt0111161/
https://www.metmuseum.org/art/collection/search/436535
https://www.smithsonianmag.com/history/the-lost-library-180975392/
https://www.nationalgeographic.com/animals/mammals/facts/red-fox
https://www.mayoclinic.org/diseases-conditions/asthma/symptoms-causes/syc-20369653
https://www.gov.uk/renew-adult-passport
https://www.loc.gov/collections/civil-war-maps/about-this-collection/
https://www.jstor.org/stable/2118477
https://www.rfc-editor.org/rfc/rfc9110.html
https://developer.mozilla.org/en-US/docs/Web/HTTP/Status
https://www.postgresql.org/docs/current/indexes-types.html
https://www.economist.com/finance-and-economics/2021/05/01/a-new-era
https://www.reuters.com/world/europe/
https://www.npr.org/sections/music-features/
https://www.zeit.de/kultur/literatur/index
https://www.lefigaro.fr/jardin/
https://www.weather.gov/forecastmaps
https://www.openstreetmap.org/about
https://www.khanacademy.org/math/algebra
https://news.ycombinator.com/item?id=2921983
https://www.goodreads.com/book/show/5107.The_Catcher_in_the_Rye
https://www.chess.com/openings
https://www.universityofcalifornia.edu/news
https://www.cs.cmu.edu/~rwh/pfpl/
https://www.lonelyplanet.com/italy/venice
https://www.instructables.com/Wooden-Bird-House/
https://www.scientificamerican.com/article/how-do-bees-make-honey/
https://www.poetryfoundation.org/poems/44272/the-road-not-taken
"""
UNWANTED = """
http://win-free-phone-now.top/claim.php?uid=83421&src=mail&c=99
http://casino-bonus-247.xyz/en/slots/?ref=aff1182&sub=77
http://cheap-pills-online-rx.biz/buy-now.html
http://secure-login-account-verify.info/update/signin.php?cmd=login_submit&id=7d3f
http://185.220.101.34/wp-content/plugins/x.php?a=1&b=2
http://bestbets365-live.win/?btag=a_1234b_567c_
http://xn--pypal-4ve-security.click/confirm?session=a8f7e6d5c4b3a2918
http://free-gift-cards-4u.club/survey?step=1&tid=550e8400
http://hot-singles-near-you.date/join?aff=33912&cid=adx
http://dl.crack-serial-keygen.ru/photoshop-2021-full.rar
http://loan-fast-approval-24h.loan/apply?source=pop&zone=4491
http://viagra-cialis-discount-store.pw/order/?item=100mg
http://click.trk-offers77.link/redirect?o=1182&p=33&s1=ab12&s2=cd34
http://www.poker-jackpot-777.bet/download?lang=en&clickid=9f8e7d
http://replica-watches-outlet-sale.shop/rolex-c-12.html?sort=price&page=3
http://update-flash-player-2020.download/setup.exe
http://adserver9.popads-network.stream/serve?z=9912&cb=1623456789
http://get-followers-instantly-free.online/?u=12345
http://crypto-double-bitcoin-event.site/btc?wallet=1A2b3C4d5E
http://seo-backlinks-1000-cheap.store/buy?pkg=gold&ref=77
http://movie-stream-hd-123.to/watch/9981723?token=aa81bc92
http://torrent-magnet-free4k.cc/get/819273/
http://mail-quota-exceeded-verify.tk/owa/auth.php?email=user
http://earn-5000-weekly-home.work/start?sub=fb_991&adset=22
http://onlyadult-cams-xxx.live/room/7712?promo=free100
http://diet-miracle-keto-2x.fun/offer/?s=1&t=2&u=3
http://amaz0n-prize-winner.gq/?n=88213
http://bit-coin-robot-trade.trade/reg?partner=5512&lang=de
http://iphone13-test-user.ml/index.php?lp=a1b2c3d4
http://cheapest-nike-shoes-outlet-store.us.com/air-max-90-c-3.html
http://spam-domain-8842.work/a/b/c/d/e/f/index.php?q=cheap+meds
http://login.microsftonline-0365.cf/common/oauth2?client=7781&state=99182
http://track.mailer-77.email/open?e=8812&l=1192&h=ff8812ac
http://slot-gacor-88.vip/daftar?ref=bola88
http://escort-city-24-7.men/girls?page=12&age=19
http://antivirus-alert-your-pc.host/scan?id=1182&os=win10
http://warez-download-appz.su/file/882133/
http://free-robux-generator-2021.icu/?user=kid
http://payday-cash-advance-usa.review/form?aff_id=1182&sub_id=9912
http://pharma-shop-no-prescription.eu.com/search?q=xanax&p=2
http://goo-gle-drive-share.ga/doc?usp=882&f=1a2b3c
http://football-bets-tips-sure-win.bid/today?src=tg
http://video-converter-free-full-crack.space/dl.php?f=9912
http://lottery-winner-notification-uk.party/claim?ref=UKL/99/2021
http://bulk-email-sender-pro.press/buy/?plan=3&coupon=SPAM
http://weightloss-tea-amazing.science/?utm_source=spam&utm_medium=mail&utm_campaign=8812
http://redirect.ads-click-99.racing/go?to=aHR0cDovL2V4&x=12
http://jackpot-city-spin-777.accountant/play?bonus=200
"""


def split() -> tuple[tuple[list[str], list[float]], tuple[list[str], list[float]]]:
    """(urls, labels) to train on, and those held out: a third, by a digest of the URL."""
    parts: tuple = (([], []), ([], []))
    for text, label in ((WANTED, 0.0), (UNWANTED, 1.0)):
        for url in text.split():
            urls, labels = parts[zlib.crc32(url.encode()) % 3 == 0]
            urls.append(url)
            labels.append(label)
    return parts
