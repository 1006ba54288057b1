"""How the given tables stand in for the collections: column mappings in plain SQL.

The expressions are read by Spark and by the checking engine alike, so both sides start from the
same rows. Only the mapping is shared; the queries on top of it are written twice.
"""

CUSTOMER_TITLES = {
    "id": "c_custkey",
    "title": "c_name",
    "type": "case when c_custkey%3=0 then 'tv_show' else 'movie' end",
    "genre": "case when c_custkey%7=0 then null when c_custkey%11=0 then '' else c_mktsegment end",
    "total_seasons": "case when c_custkey%3=0 then cast(c_custkey%9+1 as double) end",
    "ongoing_ind": "c_custkey%6=0",
    "complete_collection": "c_custkey%2=0",
    "brand": "'Brand '||(c_custkey%13)",
    "tmdb_id": "case when c_custkey%4=0 then null else 't'||c_custkey end",
}
# Every tenth title owns no copies: its copies go to the next title.
ORDER_COPIES = {
    "id": "o_orderkey",
    "media_title_id": "case when o_custkey%10=0 then o_custkey+1 else o_custkey end",
    "season_name": "o_orderpriority",
    "season_number": "case when o_orderkey%5=0 then null else cast(o_orderkey%5 as double) end",
    "season_part": "case when o_orderkey%6=0 then cast(o_orderkey%2+1 as double) end",
    "episodes": "cast(o_orderkey%24 as double)",
    "location_label": "'Shelf '||(o_orderkey%50)",
    "box_set": "o_orderkey%10=0",
    "complete_season": "o_orderkey%3=0",
    "disk_type": "o_orderstatus",
    "disk_region": "cast(o_orderkey%7 as double)",
    "file_size": "cast(o_orderkey%90 as double)",
    "category": "case when o_orderkey%8=0 then null else 'Category '||(o_orderkey%8) end",
    "compressed": "o_orderkey%4=0",
    "adjusted_file_size": "cast(o_orderkey%45 as double)",
    "disk_type_uploaded": "case when o_orderkey%2=0 then o_orderstatus end",
    "tmdb_id": "case when o_orderkey%5=1 then 'd'||o_orderkey end",
}
LINE_PURCHASES = {
    "id": "line_id",
    "dvd_item_id": "l_orderkey",
    "purchase_date": "case when l_partkey%29=0 then date '9999-12-31' when l_partkey%31=0 then null"
                     " else cast(l_shipdate as date) end",
    "cost": "cast(l_extendedprice as decimal(12,2))",
    "store": "'Store '||(l_suppkey%20)",
    "condition": "case when l_linenumber%2=0 then 'New' else 'Used' end",
    "notes": "case when l_partkey%9=0 then 'note '||l_partkey end",
}

PART_TITLES = {
    "id": "p_partkey",
    "title": "p_name",
    "franchise": "p_brand",
    "genre": "case when p_partkey%7=0 then null when p_partkey%11=0 then '' else p_type end",
    "developer": "'Studio '||(p_partkey%17)",
    "publisher": "'House '||(p_partkey%7)",
    "release_year": "cast(1980+p_size as smallint)",
    "rawg_id": "case when p_partkey%5=0 then null when p_partkey%5=1 then '' else 'r'||p_partkey end",
    "complete_collection": "p_partkey%2=0",
}
LINE_COPIES = {
    "id": "line_id",
    "game_title_id": "case when l_partkey%10=0 then l_partkey+1 else l_partkey end",
    "platform": "l_returnflag||l_linestatus",
    "edition": "case when l_linenumber%3=0 then 'Standard' when l_linenumber%3=1 then 'Collector' end",
    "region": "case when l_suppkey%3=0 then 'PAL' when l_suppkey%3=1 then 'NTSC-U' else 'NTSC-J' end",
    "condition": "case l_linenumber%4 when 0 then 'Sealed' when 1 then 'CIB' when 2 then 'Loose'"
                 " else 'Digital' end",
    "location_label": "'Shelf '||(l_orderkey%50)",
    "notes": "case when l_partkey%9=0 then 'note '||l_partkey end",
}
# Lines of small quantity are copies without a purchase.
GAME_PURCHASE_FILTER = "l_quantity > 10"
LINE_GAME_PURCHASES = {
    "id": "line_id",
    "game_copy_id": "line_id",
    "purchase_date": "cast(l_shipdate as date)",
    "cost": "cast(l_quantity as decimal(8,2))",
    "store": "'Store '||(l_suppkey%20)",
    "condition": "case when l_linenumber%2=0 then 'New' else 'Used' end",
    "notes": "case when l_partkey%8=0 then 'bought '||l_partkey end",
    "created_at": "l_shipdate",
    "updated_at": "l_shipdate",
}

ORDER_BOXES = {
    "acquisition_id": "o_orderkey",
    "purchase_date": "cast(o_orderdate as date)",
    "description": "'Box '||o_orderkey",
    "game": "case o_orderkey%5 when 0 then 'mtg' when 1 then 'weiss' when 2 then 'pokemon'"
            " when 3 then 'other' else 'mixed' end",
    "product_type": "case o_orderkey%6 when 0 then 'sealed_box' when 1 then 'sealed_pack'"
                    " when 2 then 'bundle' when 3 then 'single' when 4 then 'bulk_lot'"
                    " else 'other' end",
    "set_code": "'SET'||(o_custkey%50)",
    "language": "case when o_custkey%4=0 then 'JP' else 'EN' end",
    "quantity": "cast(1 as int)",
    "packs_total": "case when o_orderkey%4=0 then null else cast(o_orderkey%24+1 as int) end",
    "cards_per_pack": "case when o_orderkey%4=0 then null else cast(o_orderkey%12+1 as int) end",
    "packs_opened": "case when o_orderkey%3=0 then null else cast(o_orderkey%20 as int) end",
    "purchase_price": "cast(o_custkey%200 as decimal(12,2))",
    "tax": "cast(o_orderkey%9 as decimal(12,2))",
    "shipping_in": "cast(0.99 as decimal(12,2))",
    "other_fees": "cast(0 as decimal(12,2))",
    "currency": "'USD'",
    "fx_rate_to_usd": "cast(1 as decimal(14,6))",
    "total_cost": "cast(cast(o_custkey%200 + o_orderkey%9 as decimal(12,2)) + 0.99 as decimal(12,2))",
    "source": "o_orderpriority",
    "channel": "case o_custkey%3 when 0 then 'lgs' when 1 then 'ebay' else 'tcgplayer' end",
    "status": "case o_orderkey%4 when 0 then 'sealed' when 1 then 'partial' when 2 then 'opened'"
              " else 'resold_sealed' end",
    "notes": "cast(null as string)",
    "created_at": "cast(o_orderdate as timestamp)",
}
VALUE_AT_OPEN = (
    "case when l_orderkey%10=0 or l_partkey%13=0 then null else cast(l_quantity as decimal(12,2)) end"
)
GRADED = "l_suppkey%5=0"
LINE_ITEMS = {
    "item_id": "line_id",
    "acquisition_id": "l_orderkey",
    "kind": "'card'",
    "name": "p_name",
    "game": "case when l_partkey%2=0 then null else case l_suppkey%4 when 0 then 'mtg'"
            " when 1 then 'weiss' when 2 then 'pokemon' else 'other' end end",
    "set_code": "'S'||l_suppkey",
    "collector_number": "l_suppkey||'/'||l_linenumber",
    "variant": "case l_returnflag when 'A' then 'Foil' when 'R' then 'SR' end",
    "language": "'EN'",
    "condition": "case l_linenumber%6 when 0 then null when 1 then 'NM' when 2 then 'LP'"
                 " when 3 then 'MP' when 4 then 'HP' else 'NM' end",
    "grader": f"case when {GRADED} then 'PSA' end",
    "grade": f"case when {GRADED} then cast(l_linenumber+3 as decimal(4,1)) end",
    "cert_number": f"case when {GRADED} then 'C'||line_id end",
    "grade_date": f"case when {GRADED} then cast(l_shipdate as date) end",
    "cost_basis": "cast(cast(l_partkey%40 as decimal(12,2)) + cast(l_discount as decimal(12,2))"
                  " as decimal(12,2))",
    "grading_fee": f"cast(case when {GRADED} then 19.99 else 0 end as decimal(12,2))",
    "grading_ship": f"cast(case when {GRADED} then 4.50 else 0 end as decimal(12,2))",
    "grading_extra": "cast(0 as decimal(12,2))",
    "grading_total": f"cast(case when {GRADED} then 24.49 else 0 end as decimal(12,2))",
    "market_value_at_open": VALUE_AT_OPEN,
    "market_value": "case when l_partkey%17=0 then null"
                    " when l_partkey%19=0 then cast(l_tax as decimal(12,2))"
                    " else cast(cast(l_quantity as decimal(12,2)) + cast(l_discount as decimal(12,2))"
                    " as decimal(12,2)) end",
    "status": "case when l_returnflag='R' then 'sold' else case l_partkey%7 when 0 then 'keep'"
              " when 1 then 'listed' when 2 then 'lost' when 3 then 'grading' else 'inventory' end"
              " end",
    "grade_candidate": "l_partkey%23=0",
    "graded_value_est": "case when l_partkey%4=0 then cast(l_linenumber*20 as decimal(12,2)) end",
    "storage_location": "case when l_partkey%6=0 then null else 'Shelf '||(l_orderkey%50) end",
    "tcgplayer_product_id": "'P'||l_partkey",
    "image_url": "case l_partkey%3 when 0 then null when 1 then '' else 'http://img/'||line_id end",
    "notes": "cast(null as string)",
    "created_at": "cast(l_shipdate as timestamp)",
}
FIRST_SALE_FILTER = f"l_returnflag='R' and {VALUE_AT_OPEN} is not null"
SECOND_SALE_FILTER = "l_returnflag='R' and l_linenumber=1"
NO_MONEY = "cast(0 as decimal(12,2))"
FIRST_NET = "cast(l_quantity as decimal(12,2)) - cast(l_tax as decimal(12,2))"


def _sale(sale_id: str, channel: str, net: str) -> dict[str, str]:
    return {
        "sale_id": sale_id,
        "item_id": "line_id",
        "sale_date": "cast(l_shipdate as date)",
        "channel": channel,
        "gross_price": f"cast({net} + 1 as decimal(12,2))",
        "shipping_charged": NO_MONEY,
        "marketplace_fee": "cast(1 as decimal(12,2))",
        "processing_fee": NO_MONEY,
        "promo_fee": NO_MONEY,
        "shipping_paid": NO_MONEY,
        "supplies_cost": NO_MONEY,
        "net_proceeds": f"cast({net} as decimal(12,2))",
        "notes": "cast(null as string)",
        "created_at": "cast(l_shipdate as timestamp)",
    }


FIRST_SALES = _sale(
    "line_id*2", "case when line_id%2=0 then 'ebay' else 'tcgplayer' end", FIRST_NET
)
SECOND_SALES = _sale("line_id*2+1", "'lgs'", "1.25")

# Export rows of a batch (one per supplier), headed like a card export.
LINE_EXPORT = {
    "batch_id": "l_suppkey",
    "row_pos": "line_id",
    "Product Name": "case when l_partkey%37=0 then ' ' else p_name end",
    "Product Line": "case l_partkey%4 when 0 then 'Pokemon' when 1 then ' Weiss Schwarz'"
                    " when 2 then 'MAGIC' else 'Unknown' end",
    "Set Name": "'Set '||(l_partkey%9)",
    "Number": "'SFN/S'||l_suppkey||'-E'||l_linenumber||"
              "case l_linenumber%3 when 0 then ' r' when 1 then ' SR' else '' end",
    "Rarity": "case l_partkey%3 when 0 then 'R' when 1 then 'SR' else 'C' end",
    "Printing": "case l_linenumber%3 when 0 then 'Foil' when 1 then 'Normal' else '' end",
    "Condition": "case l_linenumber%4 when 0 then 'Near Mint' when 1 then 'lightly played'"
                 " when 2 then 'DAMAGED' else 'odd' end",
    "TCG Market Price": "case l_partkey%5 when 0 then '' when 1 then '$1.50'"
                        " else cast(cast(l_quantity+l_discount as decimal(12,2)) as string) end",
    "Paid": "case when l_partkey%6=0 then '2.25' when l_partkey%43=0 then 'free' else '' end",
    "Product ID": "cast(l_partkey as string)",
    "Photo URL": "case l_partkey%3 when 0 then '' else 'http://img/'||l_partkey end",
    "Add to Quantity": "case l_linenumber%5 when 0 then '' when 1 then '2' when 2 then '2.9'"
                       " when 3 then 'x' else '0' end",
}
# Names with commas, quotes and line breaks, and four kinds of export, each with its own header.
BROKEN_NAME = ("p_name||case line_id%7 when 0 then chr(10)||'second, \"line\"'"
               " when 1 then ', first' when 2 then chr(10)||chr(10)||'\"\"third' else '' end")
DIALECT = "l_suppkey%4"
LINE_TYPED = {
    "batch_id": "l_suppkey",
    "row_idx": "line_id",
    "name": "case when l_partkey%37=0 then '  ' else ' '||p_name end",
    "set_code": "case when l_partkey%2=0 then '' else 'TS'||(l_suppkey%30) end",
    "collector_number": "l_suppkey||'/'||l_linenumber||' '",
    "variant": "case when l_linenumber%2=0 then ' Foil' else '' end",
    "condition": "case when l_linenumber=6 then 'Mint' else"
                 " case l_linenumber%3 when 0 then 'NM' when 1 then '' else 'LP' end end",
    "market_value": "case l_partkey%5 when 0 then null when 1 then 'n/a'"
                    " else ' '||cast(cast(l_quantity+l_discount as decimal(12,2)) as string) end",
    "paid": "case when l_partkey%6=0 then '2.25' else '' end",
    "image_url": "cast(null as string)",
    "qty": "case l_linenumber%5 when 0 then '' when 1 then '2' when 2 then '2.9'"
           " when 3 then 'x' else '0' end",
    "game": "case when l_suppkey%30=14 then 'chess' else"
            " case l_suppkey%3 when 0 then ' MTG' when 1 then '' else 'pokemon' end end",
    "tcgplayer_product_id": "cast(null as string)",
}
# Typed lists and exports share the batches between them.
TYPED_BATCH = "l_suppkey%5=4"
SUPPLIER_MANIFEST = {
    "batch_id": "s_suppkey",
    "file_name": "case when s_suppkey%5=4 then null when s_suppkey%31=9 then ' '"
                 " else 'upload '||s_suppkey||'.csv' end",
    "mode": "case when s_suppkey%23=7 then 'bogus' else case s_suppkey%4 when 0 then 'sealed'"
            " when 1 then 'sealed' when 2 then 'singles' else 'append' end end",
    "intake": "case when s_suppkey%5=4 then 'manual' else 'csv' end",
    "description": "case when s_suppkey%17=3 then ' ' else 'Import '||s_suppkey end",
    "purchase_date": "'2026-01-'||lpad(cast(s_suppkey%28+1 as string),2,'0')",
    "product_type": "case s_suppkey%7 when 0 then 'sealed_box' when 1 then 'sealed_pack'"
                    " when 2 then 'bundle' when 3 then 'bulk_lot' when 4 then 'other'"
                    " when 5 then 'single' end",
    "game": "case s_suppkey%3 when 0 then 'weiss' when 1 then 'mtg' end",
    "language": "case when s_suppkey%6=0 then 'JP' when s_suppkey%6=1 then '' else 'EN' end",
    "price": "case when s_suppkey%29=5 then '' else cast(cast(s_acctbal as decimal(12,2)) as string)"
             " end",
    "tax": "'1.25'",
    "shipping": "' 4.5 '",
    "other_fees": "'n/a'",
    "packs_total": "case when s_suppkey%3=0 then '' else cast(s_suppkey%30 as string) end",
    "cards_per_pack": "'9'",
    "packs_now": "case when s_suppkey%2=0 then null else cast(s_suppkey%12 as string) end",
    "source": "s_name",
    "channel": "case when s_suppkey%2=0 then '' else 'lgs' end",
    "acquisition_id": "case when s_suppkey%19=2 then '' when s_suppkey%19=3 then '999999999999'"
                      " else cast((s_suppkey - s_suppkey%8)*3 as string) end",
    "basis": "case when s_suppkey%10=9 then 'as_paid' end",
}
OVERRIDE_PRICE = (
    "case (batch_id+card_index)%4 when 0 then '3.10' when 1 then 'none' when 2 then '' end"
)

# Texts entered by a change event; null means the field was not sent.
EVENT_FIELDS = {
    "status": "case event_type when 'error' then case when event_id%3=0 then 'keep' end"
              " when 'purchase' then null else case event_id%11 when 0 then '' when 1 then 'keep'"
              " when 2 then 'listed' when 3 then 'bogus' when 4 then 'lost' end end",
    "condition": "case when event_type in ('click','view') then case event_id%6 when 0 then ''"
                 " when 1 then 'NM' when 2 then 'LP' end end",
    "storage_location": "case event_type when 'signup' then case when event_id%9=0 then '' else"
                        " 'Bin '||(event_id%40) end when 'view' then case when event_id%4=0 then"
                        " 'Tray '||event_id end end",
    "market_value": "case when event_type='click' then case event_id%3 when 0 then ''"
                    " when 1 then cast(cast(value as decimal(12,2)) as string) end end",
    "graded_value_est": "case when event_type='view' and event_id%2=0 then '99.5' end",
    "grade_candidate": "case when event_type='click' and event_id%2=0 then 'on' end",
    "notes": "case when event_type='view' then case when event_id%5=0 then '' else event_type end"
             " end",
    "sale_date": "case when event_type='purchase' then case event_id%10 when 0 then ''"
                 " else cast(cast(ts as date) as string) end end",
    "channel": "case when event_type='purchase' and event_id%2=0 then 'ebay' end",
    "gross_price": "case when event_type='purchase' then"
                   " cast(cast(value as decimal(12,2)) as string) end",
    "marketplace_fee": "case when event_type='purchase' then '0.35' end",
    "grader": "case when event_type='error' then case event_id%7 when 0 then 'Nobody' when 1 then ''"
              " else 'PSA' end end",
    "grade": "case when event_type='error' then '9.5' end",
    "cert_number": "case when event_type='error' then 'E'||event_id end",
    "grade_date": "case when event_type='error' then cast(cast(ts as date) as string) end",
    "grading_fee": "case when event_type='error' then '25' end",
}
CHANGE_EVENTS = {
    "event_id": "event_id",
    "seq": "event_id",
    "kind": "case event_type when 'purchase' then 'sale' when 'error' then 'grade'"
            " when 'signup' then 'location' else 'edit' end",
    "item_id": "event_id - event_id%4 + 1",
    "acquisition_id": "event_id - event_id%4",
}

# Saved service answers: a customer's or a part's search with a few results each, numbered i.
MEDIA_RESULTS = "cast(c_custkey%8 as int)"
MEDIA_RESULT = {
    "id": "c_custkey*10+i",
    "media_type": "case (c_custkey+i)%4 when 0 then 'movie' when 1 then 'tv' when 2 then 'person'"
                  " else 'movie' end",
    "title": "case when (c_custkey+i)%4=0 then 'Film '||(c_custkey*10+i)"
             " when (c_custkey+i)%4=3 then '' end",
    "name": "case when i%3=0 then null else 'Show '||(c_custkey*10+i) end",
    "release_date": "case when (c_custkey+i)%4=0 then (1950+c_custkey%70)||'-05-17' end",
    "first_air_date": "case when (c_custkey+i)%4=1 then (1960+c_custkey%60)||'-01-02' end",
    "poster_path": "case c_custkey%3 when 0 then null when 1 then '' else '/p'||(c_custkey*10+i)||'.jpg'"
                   " end",
}
FIRST_GENRE = "(c_custkey+i)%30"
NATION_GENRES = {
    "media_type": "case when n_nationkey%2=0 then 'movie' else 'tv' end",
    "id": "n_nationkey",
    "name": "n_name",
}
GAME_RESULTS = "cast(p_partkey%8 as int)"
GAME_RESULT = {
    "id": "p_partkey*10+i",
    "name": "case when i%4=0 then null else p_name||' '||i end",
    "released": "case when i%3=0 then null else (1980+p_size)||'-11-0'||i end",
    "background_image": "case when i%2=0 then 'http://bg/'||(p_partkey*10+i) end",
}
GAME_GENRE = "case when (p_partkey+i)%3=0 then null else p_type end"
DEVELOPER = "case when p_partkey%5=0 then null else 'Studio '||(p_partkey%17) end"
PUBLISHER = "case when p_partkey%6=0 then null else 'House '||(p_partkey%7) end"
