"""Each registered query again, as SQL for the checking engine over the same given tables."""

from hoardbook.plans import mapping as m


def _columns(columns: dict[str, str]) -> str:
    return ", ".join(f'{sql} as "{name}"' for name, sql in columns.items())


def half_up(numerator: str, denominator: str) -> str:
    """Whole-number quotient rounded half away from zero, from whole-number texts."""
    n, d = f"cast(({numerator}) as hugeint)", f"cast(({denominator}) as hugeint)"
    return f"(sign({n}) * ((2*abs({n}) + {d}) // (2*{d})))"


def cents(amount: str) -> str:
    return f"cast(round(({amount}) * 100) as bigint)"


def money_ratio(numerator: str, denominator: str) -> str:
    """Quotient of whole-number texts, in cents, as an amount."""
    return f"cast(cast({half_up(numerator, denominator)} as decimal(20,0)) * 0.01 as decimal(12,2))"


def strip(text: str) -> str:
    return f"trim({text}, ' \t\n\r')"


NUMBER = r"'^[+-]?([0-9]+(_[0-9]+)*\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"


def number(text: str) -> str:
    t = strip(text)
    return (f"case when regexp_matches({t}, {NUMBER}) then"
            f" try_cast(replace({t}, '_', '') as double) end")


def amount(text: str) -> str:
    t = strip(text)
    return (f"case when regexp_matches({t}, {NUMBER}) then"
            f" try_cast(replace({t}, '_', '') as decimal(12,2)) end")


def whole(text: str) -> str:
    return f"try_cast(trunc({number(text)}) as integer)"


def copies(text: str) -> str:
    return f"greatest(1, coalesce({whole(text)}, 1))"


def filled(text: str) -> str:
    return f"nullif({strip(text)}, '')"


# Relations by name; each may use the ones before it.
RELATIONS = {
    "line": "select *, row_number() over () as line_id from lineitem",
    "named_line": "select line.*, p_name from line join part on l_partkey = p_partkey",
    "media_titles": f"select {_columns(m.CUSTOMER_TITLES)} from customer",
    "dvd_items": f"select {_columns(m.ORDER_COPIES)} from orders",
    "media_purchases": f"select {_columns(m.LINE_PURCHASES)} from line",
    "game_titles": f"select {_columns(m.PART_TITLES)} from part",
    "game_copies": f"select {_columns(m.LINE_COPIES)} from line",
    "game_purchases":
        f"select {_columns(m.LINE_GAME_PURCHASES)} from line where {m.GAME_PURCHASE_FILTER}",
    "acquisition": f"select {_columns(m.ORDER_BOXES)} from orders",
    "item": f"select {_columns(m.LINE_ITEMS)} from named_line",
    "sale": f"select {_columns(m.FIRST_SALES)} from line where {m.FIRST_SALE_FILTER} union all "
            f"select {_columns(m.SECOND_SALES)} from line where {m.SECOND_SALE_FILTER}",
    "media_base": """
        select t.id as media_title_id, c.media_title_id as dvd_med_id, c.id as dvd_id,
            p.dvd_item_id as pi_dvd_id, p.id as pi_id, t.type, t.genre, t.title, c.season_name,
            c.season_number, c.season_part, c.location_label, p.purchase_date, p.cost, p.store,
            p.condition, p.notes, c.box_set, c.complete_season, c.category, t.complete_collection,
            c.disk_type, c.file_size, coalesce(c.tmdb_id, t.tmdb_id) as tmdb_id
        from media_titles t join dvd_items c on c.media_title_id = t.id
        left join media_purchases p on p.dvd_item_id = c.id""",
    "game_base": """
        select t.id as game_title_id, c.game_title_id as copy_title_id, c.id as game_copy_id,
            p.game_copy_id as pi_copy_id, p.id as pi_id, t.title, t.franchise, t.genre,
            t.developer, t.publisher, t.release_year, t.rawg_id, t.complete_collection,
            c.platform, c.edition, c.region, c.condition as copy_condition, c.location_label,
            c.notes as copy_notes, p.purchase_date, p.cost, p.store, p.condition, p.notes
        from game_titles t join game_copies c on c.game_title_id = t.id
        left join game_purchases p on p.game_copy_id = c.id""",
    "ledger_rows": """
        select i.* exclude (game), coalesce(i.game, a.game) as game, s.sale_id, s.sale_date,
            s.net_proceeds, s.channel as sold_via, i.cost_basis + i.grading_total as total_basis,
            case when s.sale_id is not null
                then s.net_proceeds - (i.cost_basis + i.grading_total) end as realized_profit,
            case when s.sale_id is not null
                then cast(s.sale_date - a.purchase_date as integer) end as holding_days,
            a.purchase_date, a.source, a.product_type, a.description as acquisition_description
        from item i join acquisition a on a.acquisition_id = i.acquisition_id
        left join sale s on s.item_id = i.item_id""",
    "medians": """
        select acquisition_id, v[(n - 1)//2 + 1] + 0.5::double * (v[n//2 + 1] - v[(n - 1)//2 + 1])
            as median_value
        from (select acquisition_id, count(*) as n, list_sort(list(cast(market_value as double)))
            as v from item where market_value is not null group by acquisition_id)""",
    "candidates": """
        select * from (
            select i.item_id, i.acquisition_id, i.name, i.set_code, i.condition, i.market_value,
                i.graded_value_est, i.grade_candidate,
                i.cost_basis + i.grading_total as total_basis,
                i.graded_value_est - i.market_value - 30 as est_upside, b.median_value,
                case when i.grade_candidate or (i.condition = 'NM' and i.market_value >= 25)
                        then 'grade'
                    when i.market_value >= 0.50 and b.median_value > 0
                        and cast(i.market_value as double) >= 3::double * b.median_value
                        then 'review' end as tier
            from item i left join medians b on b.acquisition_id = i.acquisition_id
            where i.grader is null and i.status in ('inventory', 'keep'))
        where tier is not null""",
    "reasons": """
        select *, case when tier = 'review' then
                '$' || format('{:,.2f}', coalesce(cast(market_value as double), 0)) || ' raw — '
                || format('{:.1f}', multiple) || '× the box median ($'
                || format('{:,.2f}', coalesce(median_value, 0)) || ')'
            else concat_ws(' · ', case when condition = 'NM' then 'NM condition' end,
                case when market_value >= 25 then
                    '$' || format('{:,.0f}', cast(market_value as double)) || ' raw value' end,
                case when grade_candidate then 'flagged by you' end, 'ungraded') end as reason
        from (select *, coalesce(cast(market_value as double) / nullif(median_value, 0), 0)
            as multiple from candidates)""",
    "graded_copies": """
        select i.item_id, i.name, i.grader, i.grade, i.market_value,
            i.cost_basis + i.grading_total as total_basis, s.net_proceeds, s.sale_date, s.sale_id,
            s.net_proceeds - (i.cost_basis + i.grading_total) as profit_after_grading
        from item i left join sale s on s.item_id = i.item_id where i.grader is not null""",
    "basis": f"""
        select item_id, acquisition_id, case when total_mv > 0 then
                {money_ratio("al * mv", "nullif(total_mv, 0)")}
            else {money_ratio("al", "n")} end as cost_basis
        from (select i.item_id, i.acquisition_id, {cents("coalesce(i.market_value_at_open, 0)")} as mv,
                b.* exclude (acquisition_id)
            from item i join (
                select a.acquisition_id, case when a.packs_total is not null
                        and a.packs_opened is not null and a.packs_total > 0
                    then {half_up(cents("any_value(a.total_cost)") + " * least(a.packs_opened, a.packs_total)", "a.packs_total")}
                    else {cents("any_value(a.total_cost)")} end as al,
                    {cents("coalesce(sum(i.market_value_at_open), 0)")} as total_mv, count(*) as n
                from acquisition a join item i on i.acquisition_id = a.acquisition_id
                group by a.acquisition_id, a.packs_total, a.packs_opened) b
            on b.acquisition_id = i.acquisition_id)""",
    "export_row": f"select {_columns(m.LINE_EXPORT)}, l_suppkey from named_line",
    "export_text": f"""
        select batch_id, row_pos, l_suppkey, {strip('"Product Name"')} as name,
            {strip('"Product Line"')} as product_line, "Set Name" as set_name,
            {strip('"Number"')} as number, "Rarity" as rarity, "Printing" as printing,
            "Condition" as condition, "TCG Market Price" as price, "Product ID" as product_id,
            "Photo URL" as image_url, "Add to Quantity" as quantity, "Paid" as paid
        from export_row""",
    "export_code": """
        select *, case lower(product_line) when 'pokemon' then 'pokemon'
                when 'weiss schwarz' then 'weiss' when 'magic' then 'mtg' else 'other' end as game,
            case when lower(split_part(number, ' ', 2)) = lower(rarity)
                then split_part(number, ' ', 1) else number end as code,
            split_part(number, ' ', 1) as old_code,
            nullif(trim(rarity || case when lower(printing) not in ('normal', '')
                then ' ' || printing else '' end), '') as variant,
            case lower(condition) when 'near mint' then 'NM' when 'lightly played' then 'LP'
                when 'damaged' then 'DMG' end as condition_code
        from export_text""",
    "normal": f"""
        select batch_id, row_pos, l_suppkey, name, game,
            case when game = 'weiss' then split_part(code, '-', 1) else nullif(set_name, '') end
                as set_code,
            code as collector_number, variant, condition_code as condition,
            {amount('price')} as market_value, nullif(product_id, '') as tcgplayer_product_id,
            nullif(image_url, '') as image_url, {amount('paid')} as paid,
            {copies('quantity')} as quantity, true as has_paid_column
        from export_code where name <> ''""",
    "typed_row": f"select {_columns(m.LINE_TYPED)}, l_suppkey from named_line",
    "typed": f"""
        select batch_id, row_idx as row_pos, l_suppkey, {filled('name')} as name,
            lower({filled('game')}) as game, {filled('set_code')} as set_code,
            {filled('collector_number')} as collector_number, {filled('variant')} as variant,
            {filled('condition')} as condition, {amount('market_value')} as market_value,
            {filled('tcgplayer_product_id')} as tcgplayer_product_id,
            {filled('image_url')} as image_url, {amount('paid')} as paid,
            {copies('qty')} as quantity, {amount('paid')} is not null as has_paid_column
        from typed_row where {filled('name')} is not null""",
    "manifest": f"select {_columns(m.SUPPLIER_MANIFEST)} from supplier",
    "import_row": f"""
        select * exclude (l_suppkey) from normal where not ({m.TYPED_BATCH})
        union all select * exclude (l_suppkey) from typed where {m.TYPED_BATCH}""",
    "summary": """
        select batch_id, cast(sum(quantity) as bigint) as n_cards,
            arg_min(set_code, row_pos) filter (coalesce(set_code, '') <> '') as set_code,
            coalesce(list_sort(list(distinct game) filter (game is not null)), []) as games,
            cast(coalesce(sum(market_value * quantity), 0) as decimal(22,2)) as total_value,
            cast(coalesce(sum(paid * quantity), 0) as decimal(22,2)) as sum_paid,
            bool_or(paid is not null) as paid_seen, bool_or(has_paid_column) as has_paid_column
        from import_row group by batch_id""",
    "batch": """
        select f.*, coalesce(s.n_cards, 0) as n_cards, s.set_code, coalesce(s.games, []) as games,
            coalesce(s.total_value, 0) as total_value, coalesce(s.sum_paid, 0) as sum_paid,
            coalesce(s.paid_seen, false) as paid_seen
        from manifest f left join summary s on s.batch_id = f.batch_id""",
    "planned": f"""
        select *, cast(purchase_price + tax + shipping_in + other_fees as decimal(12,2))
                as total_cost
        from (select batch_id, n_cards,
            cast(nullif(purchase_date, '') as date) as purchase_date,
            nullif(description, '') as description,
            case when len(games) > 1 then 'mixed' when len(games) = 1 then games[1]
                else coalesce(game, 'weiss') end as game,
            coalesce(product_type, 'sealed_box') as product_type, set_code,
            coalesce(nullif(language, ''), 'EN') as language, packs as packs_total,
            case when {whole('cards_per_pack')} > 0 then {whole('cards_per_pack')} end
                as cards_per_pack,
            case when by_pack then opened else now end as packs_opened,
            coalesce({amount('price')}, 0) as purchase_price, coalesce({amount('tax')}, 0) as tax,
            coalesce({amount('shipping')}, 0) as shipping_in,
            coalesce({amount('other_fees')}, 0) as other_fees,
            nullif(source, '') as source, nullif(channel, '') as channel,
            case when not by_pack then 'opened' when opened <= 0 then 'sealed'
                when opened >= packs then 'opened' else 'partial' end as status
        from (select *, coalesce(now, packs) as opened, coalesce(product_type, 'sealed_box') in
                ('sealed_box', 'sealed_pack', 'bundle', 'bulk_lot') and packs is not null as by_pack
            from (select *, {whole('packs_now')} as now,
                case when {whole('packs_total')} > 0 then {whole('packs_total')} end as packs
                from batch)))""",
    "reject": f"""
        select batch_id, reason from (select b.batch_id, case
            when mode not in ('sealed', 'singles', 'append') then 'Unknown import mode.'
            when mode in ('sealed', 'singles') and missing <> ''
                then 'Please fill in: ' || missing || '.'
            when mode = 'append' and coalesce(trim(acquisition_id), '') = ''
                then 'Pick an existing box to append to.'
            when intake <> 'manual' and coalesce(trim(file_name), '') = ''
                then 'Choose a TCGplayer CSV export to upload.'
            when n_cards = 0 and intake = 'manual' and mode <> 'sealed'
                then 'Enter at least one card.'
            when n_cards = 0 and intake <> 'manual'
                then 'No cards parsed from that CSV — check the format.'
            when mode = 'append' and not exists (select 1 from orders
                where o_orderkey = try_cast(b.acquisition_id as bigint))
                then 'That box no longer exists.' end as reason
        from (select *, concat_ws(', ',
                case when {filled('description')} is null then 'description' end,
                case when {filled('purchase_date')} is null then 'purchase_date' end,
                case when mode = 'sealed' and {filled('price')} is null then 'price' end)
            as missing from batch) b) where reason is not null""",
    "accepted": "select * from manifest where batch_id not in (select batch_id from reject)",
    "card": """
        select * exclude (copy_no), row_number() over (partition by batch_id
            order by row_pos, copy_no) - 1 as card_index
        from (select *, unnest(range(quantity)) as copy_no from import_row)""",
    "single": f"""
        select * exclude (entered),
            cast(coalesce(entered, paid, market_value, 0) as decimal(12,2)) as cost_basis,
            entered is null and paid is null and market_value is not null as used_fallback
        from (select * exclude (entered_text), {amount('entered_text')} as entered
            from (select *, {m.OVERRIDE_PRICE} as entered_text from card))""",
    "sealed_box": """
        select *, (select max(o_orderkey) from orders) + row_number() over (
                order by md5(cast(batch_id as varchar)), batch_id) as acquisition_id,
            cast((select count(*) from lineitem) + coalesce(sum(n_cards) over (
                order by md5(cast(batch_id as varchar)), batch_id
                rows between unbounded preceding and 1 preceding), 0) as bigint)
                as first_item
        from planned where batch_id in (select batch_id from accepted where mode = 'sealed')""",
    "single_box": """
        select *, (select max(o_orderkey) from orders) + row_number() over (
                order by md5(cast(batch_id as varchar)), batch_id) as acquisition_id,
            cast((select count(*) from lineitem) + coalesce(sum(n_cards) over (
                order by md5(cast(batch_id as varchar)), batch_id
                rows between unbounded preceding and 1 preceding), 0) as bigint)
                as first_item
        from planned where batch_id in (select batch_id from accepted where mode = 'singles')""",
    "broken_row": """
        select distinct batch_id from import_row
        where condition not in ('NM', 'LP', 'MP', 'HP', 'DMG', 'sealed')
            or game not in ('mtg', 'weiss', 'pokemon', 'other')""",
    "append_batch": f"""
        select b.batch_id, cast(acquisition_id as bigint) as acquisition_id, n_cards,
            {whole('packs_now')} as packs_now,
            cast((select count(*) from lineitem) + coalesce(sum(n_cards) over (
                order by md5(cast(b.batch_id as varchar)), b.batch_id
                rows between unbounded preceding and 1 preceding), 0) as bigint)
                as first_item
        from batch b where batch_id in (select batch_id from accepted where mode = 'append')
            and batch_id not in (select batch_id from broken_row)""",
    "append_box": """
        select a.* exclude (packs_opened, status), cast(case when more is null then packs_opened
                else coalesce(packs_opened, 0) + more end as integer) as packs_opened,
            case when more is null then status
                when coalesce(packs_opened, 0) + more >= packs_total then 'opened'
                else 'partial' end as status
        from acquisition a join (select acquisition_id, sum(packs_now) as more from append_batch
            group by acquisition_id) x on x.acquisition_id = a.acquisition_id""",
    "append_item": """
        select item_id, acquisition_id, name, market_value_at_open, status from item
            where acquisition_id in (select acquisition_id from append_batch)
        union all select b.first_item + c.card_index + 1, b.acquisition_id, c.name, c.market_value,
            'inventory' from card c join append_batch b on b.batch_id = c.batch_id""",
    "old_row": f"""
        select batch_id, row_pos, name, old_code as collector_number,
            split_part(old_code, '-', 1) as set_code, variant, condition_code as condition,
            {amount('price')} as market_value, price as price_text, paid as paid_text,
            {amount('paid')} as paid, {copies('quantity')} as quantity
        from export_code where name <> ''""",
    "old_reject": f"""
        select batch_id, reason from (select f.batch_id, case
            when {filled('f.description')} is null or {filled('f.purchase_date')} is null
                then 'A new purchase needs a description and a date.'
            when coalesce(f.basis, case when f.product_type = 'single' then 'as_paid'
                    else 'allocate' end) = 'allocate' and {amount('f.price')} is null
                then 'Allocating needs the price of the product.'
            when f.batch_id not in (select batch_id from old_row) then 'No item rows parsed.' end
            as reason from manifest f) where reason is not null""",
    "old_batch": f"""
        select *, case when basis = 'as_paid' then case when any_paid then sum_paid
                else coalesce(given, total_value) end else coalesce(given, 0) end as price_paid
        from (select f.* exclude (basis, set_code), s.*  exclude (batch_id),
            {amount('f.price')} as given, coalesce(f.basis, case when f.product_type = 'single'
                then 'as_paid' else 'allocate' end) as basis
        from (select *, null as set_code from manifest) f join (select batch_id,
                cast(sum(quantity) as bigint) as n_cards, arg_min(set_code, row_pos) as set_code,
                cast(coalesce(sum(market_value * quantity), 0) as decimal(22,2)) as total_value,
                cast(coalesce(sum(case when price_text = '' or market_value is not null
                    then paid * quantity end), 0) as decimal(22,2)) as sum_paid,
                bool_or(paid_text <> '') as any_paid
            from old_row group by batch_id) s on s.batch_id = f.batch_id)
        where batch_id not in (select batch_id from old_reject)""",
    "old_box": f"""
        select *, cast(purchase_price + tax + shipping_in + other_fees as decimal(12,2))
                as total_cost,
            (select max(o_orderkey) from orders) + row_number() over (
                order by md5(cast(batch_id as varchar)), batch_id) as acquisition_id,
            cast((select count(*) from lineitem) + coalesce(sum(n_cards) over (
                order by md5(cast(batch_id as varchar)), batch_id
                rows between unbounded preceding and 1 preceding), 0) as bigint)
                as first_item
        from (select batch_id, n_cards, basis, given, cast(purchase_date as date) as purchase_date,
            nullif(description, '') as description, coalesce(game, 'weiss') as game,
            coalesce(product_type, 'sealed_box') as product_type, set_code,
            coalesce(nullif(language, ''), 'EN') as language, packs as packs_total,
            {whole('cards_per_pack')} as cards_per_pack,
            case when by_pack then coalesce(now, packs) else now end as packs_opened,
            cast(price_paid as decimal(12,2)) as purchase_price,
            coalesce({amount('tax')}, 0) as tax, coalesce({amount('shipping')}, 0) as shipping_in,
            coalesce({amount('other_fees')}, 0) as other_fees, nullif(source, '') as source,
            nullif(channel, '') as channel,
            case when not by_pack or coalesce(now, packs) >= packs then 'opened' else 'partial' end
                as status
        from (select *, coalesce(product_type, 'sealed_box') in
                ('sealed_box', 'sealed_pack', 'bundle', 'bulk_lot') and packs is not null as by_pack
            from (select *, {whole('packs_now')} as now,
                case when {whole('packs_total')} > 0 then {whole('packs_total')} end as packs
                from old_batch)))""",
    "old_item": """
        select b.first_item + c.card_index + 1 as item_id, c.batch_id, c.card_index,
            b.acquisition_id, c.name, cast(null as varchar) as game, c.set_code, b.language,
            c.condition, c.market_value, 'inventory' as status, b.basis,
            case when c.paid_text <> '' then c.paid when b.n_cards = 1 and b.given is not null
                then b.given else c.market_value end as paid_basis, b.total_cost,
            b.packs_total, b.packs_opened
        from (select * exclude (copy_no), row_number() over (partition by batch_id
                order by row_pos, copy_no) - 1 as card_index
            from (select *, unnest(range(quantity)) as copy_no from old_row)) c
        join old_box b on b.batch_id = c.batch_id""",
    "la_batch": f"""
        select *, cast((select count(*) from lineitem) + coalesce(sum(n_cards) over (
                order by basis = 'allocate', md5(cast(batch_id as varchar)), batch_id
                rows between unbounded preceding and 1 preceding), 0) as bigint) as first_item
        from (select f.batch_id, try_cast(f.acquisition_id as bigint) as acquisition_id, n_cards,
            {amount('f.price')} as given, {whole('f.packs_now')} as packs_now,
            coalesce(f.basis, case when f.product_type = 'single' then 'as_paid' else 'allocate' end)
                as basis
        from manifest f join (select batch_id, cast(sum(quantity) as bigint) as n_cards
            from old_row group by batch_id) s on s.batch_id = f.batch_id where f.mode = 'append')
        where acquisition_id in (select o_orderkey from orders)""",
    "la_box": """
        select a.* exclude (packs_opened), cast(case when more is null then packs_opened
            else coalesce(packs_opened, 0) + more end as integer) as packs_opened
        from acquisition a join (select acquisition_id, sum(packs_now) as more from la_batch
            group by acquisition_id) x on x.acquisition_id = a.acquisition_id""",
    "la_item": """
        select item_id, acquisition_id, name, market_value_at_open, status, cost_basis as held_basis
            from item where acquisition_id in (select acquisition_id from la_batch)
        union all select b.first_item + c.card_index + 1, b.acquisition_id, c.name, c.market_value,
            'listed', cast(case when c.paid_text <> '' then c.paid when b.n_cards = 1
                and b.given is not null then b.given else c.market_value end as decimal(12,2))
        from (select * exclude (copy_no), row_number() over (partition by batch_id
                order by row_pos, copy_no) - 1 as card_index
            from (select *, unnest(range(quantity)) as copy_no from old_row)) c
        join la_batch b on b.batch_id = c.batch_id""",
    "event": f"select {_columns(m.CHANGE_EVENTS)}, {_columns({'f_' + k: v for k, v in m.EVENT_FIELDS.items()})} from events",
    "bad_event": """
        select event_id, kind, reason from (select event_id, kind, case
            when kind = 'edit' and f_status is not null and f_status not in
                ('inventory', 'listed', 'sold', 'keep', 'grading', 'lost') then 'status'
            when kind = 'edit' and f_condition not in ('', 'NM', 'LP', 'MP', 'HP', 'DMG', 'sealed')
                then 'condition'
            when kind = 'sale' and coalesce(f_sale_date, '') = '' then 'sale_date'
            when kind = 'sale' and cast(f_gross_price as decimal(12,2)) < 0 then 'gross_price'
            when kind = 'grade' and f_grader not in ('', 'PSA', 'BGS', 'CGC', 'TAG', 'SGC', 'other')
                then 'grader'
            when kind = 'grade' and f_status not in
                ('', 'inventory', 'listed', 'sold', 'keep', 'grading', 'lost') then 'status'
            when kind = 'sale' and (item_id is null or item_id > (select count(*) from lineitem))
                then 'item_id' end
            as reason from event) where reason is not null""",
    "good_event":
        "select * from event where event_id not in (select event_id from bad_event)",
}

SUMS = "decimal(22,2)"
LEDGER = ("item_id, acquisition_id, name, set_code, status, condition, grader, grade, total_basis,"
          " market_value, sale_date, net_proceeds, realized_profit, holding_days, purchase_date,"
          " source, sold_via")
LEDGER_BASE = ("item_id, acquisition_id, name, set_code, status, condition, grader, grade,"
               " total_basis, market_value, realized_profit, sale_date, purchase_date, variant,"
               " collector_number, image_url, game, acquisition_description")
DETAIL = ("item_id, acquisition_id, name, set_code, status, condition, grader, grade, total_basis,"
          " market_value, sale_date, net_proceeds, realized_profit, holding_days, purchase_date,"
          " source, sold_via, variant, collector_number, language, image_url,"
          " tcgplayer_product_id, storage_location, cost_basis, grade_candidate,"
          " graded_value_est, cert_number, grade_date, grading_fee, grading_ship, grading_extra,"
          " grading_total, notes, acquisition_description, game, product_type")
OWNED = "('inventory', 'listed', 'keep', 'grading')"


def _box_pl(sale_source: str, net: str) -> str:
    """Profit and loss over the plain fan-out join; ``net`` is an item's sale amount."""
    invested = "total_cost + grading_spend"
    result = "realized_net + unsold_value - total_cost - grading_spend"
    return f"""
        select acquisition_id, purchase_date, description, game, total_cost, grading_spend,
            cast({invested} as {SUMS}) as total_invested, packs_total,
            {money_ratio(cents("total_cost"), "packs_total")} as cost_per_pack, items, ev_at_open,
            realized_net, unsold_value,
            cast(realized_net + unsold_value as {SUMS}) as recovered_value,
            cast({result} as {SUMS}) as net_result,
            cast(cast({half_up("1000 * " + cents(result), f"nullif({cents(invested)}, 0)")}
                as decimal(20,0)) * 0.1 as decimal(22,1)) as roi_pct
        from (select a.acquisition_id, a.purchase_date, a.description, a.game, a.total_cost,
                a.packs_total, cast(coalesce(sum(i.grading_total), 0) as {SUMS}) as grading_spend,
                count(i.item_id) as items,
                cast(coalesce(sum(i.market_value_at_open), 0) as {SUMS}) as ev_at_open,
                cast(coalesce(sum({net}), 0) as {SUMS}) as realized_net,
                cast(coalesce(sum(i.market_value) filter (i.status in {OWNED}), 0) as {SUMS})
                    as unsold_value
            from acquisition a left join item i on i.acquisition_id = a.acquisition_id
            left join {sale_source} s on s.item_id = i.item_id
            group by a.acquisition_id, a.purchase_date, a.description, a.game, a.total_cost,
                a.packs_total)"""


def _dashboard(base: str, columns: list[str], kind: str) -> str:
    numbers = f"count(*) as count, cast(sum(cost) as {kind}) as sum from {base}"
    parts = [f"select 'total' as metric, cast(null as varchar) as value, {numbers}"] + [
        f"select '{c}', {c}, {numbers} group by {c}" for c in columns
    ]
    return " union all ".join(parts)


def _dup_check(probe: str, table: str, copies_table: str, title_key: str, columns: str, label: str):
    listed = ", ".join(f"t.{c}" for c in columns.split(", "))
    return f"""
        select p.probe, position, {columns}, {label} from (
            select p.probe, {listed}, cast(row_number() over (partition by p.probe
                order by t.title, t.id) as integer) as position,
                (select count(*) from {copies_table} c where c.{title_key} = t.id) as {label}
            from (select distinct {strip('probe')} as probe from ({probe})
                where {filled('probe')} is not null) p
            join {table} t on t.title ilike '%' || p.probe || '%') p where position <= 5"""


def _imported(box: str, cards: str, basis: str) -> str:
    return f"""
        select b.first_item + c.card_index + 1 as item_id, c.batch_id, c.card_index,
            b.acquisition_id, c.name, c.game, c.set_code, b.language, c.condition,
            {basis} as cost_basis, c.market_value, 'inventory' as status
        from {cards} c join {box} b on b.batch_id = c.batch_id"""


def _allocated(rows: str) -> str:
    """Basis of rows with total_cost, packs and their own value, settled per acquisition."""
    al = (f"case when packs_total > 0 and packs_opened is not null then"
          f" {half_up(cents('total_cost') + ' * least(packs_opened, packs_total)', 'packs_total')}"
          f" else {cents('total_cost')} end")
    return f"""
        select *, case when total_mv > 0 then
                {money_ratio("al * own_mv", "nullif(total_mv, 0)")}
            else {money_ratio("al", "n")} end as settled
        from (select *, {al} as al, {cents("coalesce(own_value, 0)")} as own_mv,
                {cents("coalesce(sum(own_value) over (partition by acquisition_id), 0)")}
                    as total_mv,
                count(*) over (partition by acquisition_id) as n from ({rows}))"""


BOX_COLUMNS = ("b.batch_id, b.acquisition_id, b.purchase_date, b.description, b.game,"
               " b.product_type, b.set_code, b.language, 1 as quantity, b.packs_total,"
               " b.cards_per_pack, b.packs_opened, b.purchase_price, b.tax, b.shipping_in,"
               " b.other_fees, 'USD' as currency, cast(1 as decimal(14,6)) as fx_rate_to_usd,"
               " b.total_cost, b.source, b.channel, b.status, cast(null as varchar) as notes")


def _writes(kinds: str) -> str:
    """Per item the last write to each column, over the valid events of some kinds."""
    def last(name: str, written: str, value: str) -> str:
        return f"arg_max({{'v': {value}, 's': seq}}, seq) filter ({written}) as w_{name}"

    def edited(name: str, value: str) -> str:
        return last(name, f"kind = 'edit' and f_{name} is not null", value)

    parts = [
        last("status", "kind in ('sale', 'grade') or (kind = 'edit' and f_status is not null)",
             "case kind when 'edit' then nullif(f_status, '') when 'sale' then 'sold'"
             " else coalesce(nullif(f_status, ''), 'inventory') end"),
        edited("condition", "nullif(f_condition, '')"),
        edited("storage_location", "nullif(f_storage_location, '')"),
        edited("market_value", amount("f_market_value")),
        edited("graded_value_est", amount("f_graded_value_est")),
        last("grade_candidate", "kind in ('edit', 'grade')",
             "kind = 'edit' and coalesce(f_grade_candidate in ('on', 'true', '1'), false)"),
        edited("notes", "nullif(f_notes, '')"),
        last("grader", "kind = 'grade'", "nullif(f_grader, '')"),
        last("grade", "kind = 'grade'", "cast(f_grade as decimal(4,1))"),
        last("cert_number", "kind = 'grade'", "f_cert_number"),
        last("grade_date", "kind = 'grade'", "cast(f_grade_date as date)"),
        last("grading_fee", "kind = 'grade'", "cast(coalesce(f_grading_fee, '0') as decimal(12,2))"),
        last("grading_ship", "kind = 'grade'", "cast(0 as decimal(12,2))"),
        last("grading_extra", "kind = 'grade'", "cast(0 as decimal(12,2))"),
    ]
    return f"select item_id, {', '.join(parts)} from good_event where kind in {kinds} group by item_id"


def _changed(kinds: str) -> str:
    def now(name: str) -> str:
        return f"case when w.w_{name} is not null then w.w_{name}.v else i.{name} end"

    names = ["status", "condition", "market_value", "graded_value_est", "grade_candidate", "notes",
             "grader", "grade", "cert_number", "grade_date", "grading_fee", "grading_ship",
             "grading_extra"]
    place = ("case when x.w_box is not null and (w.w_storage_location is null"
             " or x.w_box.s > w.w_storage_location.s) then x.w_box.v"
             " when w.w_storage_location is not null then w.w_storage_location.v"
             " else i.storage_location end")
    return f"""
        select *, cast(grading_fee + grading_ship + grading_extra as decimal(12,2))
            as grading_total
        from (select i.item_id, {", ".join(f"{now(c)} as {c}" for c in names)},
            {place} as storage_location
        from item i left join ({_writes(kinds)}) w on w.item_id = i.item_id
        left join (select acquisition_id, arg_max(
                {{'v': nullif(f_storage_location, ''), 's': seq}}, seq) as w_box
            from good_event where kind = 'location' and kind in {kinds} group by acquisition_id) x
        on x.acquisition_id = i.acquisition_id)"""


def _results(table: str, key: str, count: str, fields: dict[str, str]) -> str:
    return (f"select {key} as query_id, i, {_columns(fields)} from (select *, unnest(range(1, 9))"
            f" as i from {table}) where i <= {count}")


QUERIES = {
    # Sources
    "intake_csv_scan": f"""
        select batch_id || '-' || (row_pos // 1000000) as file,
            row_number() over (partition by batch_id, row_pos // 1000000 order by row_pos)
                as row_pos,
            name, product_line, {strip('set_name')} as set_name, number, rarity, printing,
            condition, price, product_id, image_url, quantity, paid, true as has_paid_column
        from export_text""",
    "intake_export_split": f"""
        select row_pos // 1000000 as file,
            row_number() over (partition by row_pos // 1000000 order by row_pos) as row_pos,
            {m.BROKEN_NAME} as name, number, price, paid, quantity, true as has_paid_column
        from (select *, row_pos as line_id, p_name from export_text join (select line_id as id,
            p_name from named_line) on id = row_pos)""",
    "intake_export_dialects": f"""
        select dialect, file, row_number() over (partition by dialect, file order by line_id)
                as row_pos,
            case when dialect = 3 then '' else {m.BROKEN_NAME} end as name,
            case when dialect in (2, 3) then number else '' end as number,
            case when dialect in (0, 1) then price else '' end as price,
            case when dialect in (0, 2) then paid else '' end as paid,
            quantity, dialect in (0, 2) as has_paid_column
        from (select *, {m.DIALECT} as dialect, line_id // 1000000 as file from (
            select e.*, l.line_id, l.p_name, l.l_suppkey from export_text e
            join named_line l on l.line_id = e.row_pos))""",
    "intake_manual_rows": "select * exclude (l_suppkey) from typed",
    "intake_media_rows": """
        select l_orderkey as media_title_id,
            case l_linenumber%4 when 1 then 2.0::double when 2 then 2.5::double end as season_number,
            case when l_partkey%2=0 then 1.0::double end as season_part, 10.0::double as episodes,
            'Shelf '||(l_orderkey%50) as location_label, '' as season_name,
            l_partkey%3=0 as box_set, l_partkey%3<>1 as complete_season, 'd'||line_id as tmdb_id,
            l_linestatus as disk_type, 1.0::double as disk_region, l_quantity as file_size,
            l_returnflag as category, true as compressed, 100.0::double as adjusted_file_size,
            '' as disk_type_uploaded from line""",
    "intake_media_titles": """
        select c_name as title, case when c_custkey%3=0 then 'tv_show' else 'movie' end as type,
            c_mktsegment as genre, case when c_custkey%3=1 then 4.0::double end as total_seasons,
            c_custkey%2=0 as ongoing_ind, c_custkey%5=0 as complete_collection, '' as brand,
            't'||c_custkey as tmdb_id from customer""",
    "intake_game_rows": """
        select line_id as game_copy_id,
            case when l_partkey%7<>0 then cast(l_shipdate as date) end as purchase_date,
            case when l_linenumber%3=1 then 12.50::decimal(12,2) end as cost,
            'Store '||(l_suppkey%20) as store, '' as condition, cast(null as varchar) as notes
        from line""",
    "intake_game_titles": """
        select p_name as title, p_brand as franchise, p_type as genre, '' as developer,
            '' as publisher,
            case when p_partkey%4<>0 then cast(1980+p_size as smallint) end as release_year,
            'r'||p_partkey as rawg_id, p_partkey%2=0 as complete_collection from part""",
    "intake_game_copies": """
        select l_partkey as game_title_id, l_returnflag||l_linestatus as platform, '' as edition,
            'PAL' as region, 'Loose' as condition, 'Shelf '||(l_orderkey%50) as location_label,
            '' as notes from line""",
    "generated_columns": """
        select 'acquisition' as table_name, acquisition_id as key, total_cost as amount
            from acquisition
        union all select 'item', item_id, grading_total from item
        union all select 'sale', sale_id, net_proceeds from sale""",
    "apply_defaults": """
        select acquisition_id, purchase_price, case when acquisition_id%3<>0 then tax end as tax,
            'EN' as language, 1 as quantity, cast(0 as decimal(12,2)) as shipping_in,
            cast(0 as decimal(12,2)) as other_fees, 'USD' as currency,
            cast(1 as decimal(14,6)) as fx_rate_to_usd, 'sealed' as status from acquisition""",
    # Catalogues
    "media_base": "select * from media_base",
    "media_recent": """
        select * from media_base where purchase_date <> date '9999-12-31'
            and purchase_date is not null order by purchase_date desc, pi_id limit 10""",
    "media_count": "select count(*) as count from media_base",
    "media_count_by_genre": "select genre, count(genre) as count from media_base group by genre",
    "media_count_by_type": "select type, count(type) as count from media_base group by type",
    "media_cost_by_type":
        f"select type, cast(sum(cost) as {SUMS}) as sum from media_base group by type",
    "media_cost_by_disk":
        f"select disk_type, cast(sum(cost) as {SUMS}) as sum from media_base group by disk_type",
    "media_dashboard": _dashboard("media_base", ["type", "genre", "disk_type"], SUMS),
    "game_dashboard": _dashboard("game_base", ["genre", "platform"], "decimal(18,2)"),
    "media_cost_by_store":
        f"select store, cast(sum(cost) as {SUMS}) as sum from media_purchases group by store",
    "media_location_count":
        "select count(*) as count from media_base where location_label ilike '%shelf 1%'",
    "media_genres": "select distinct genre from media_titles where genre <> ''",
    "media_title_detail": """
        select c.media_title_id as title_id, c.id as dvd_id, c.season_name, c.season_number,
            c.season_part, c.episodes, c.location_label, c.disk_type, c.disk_region, c.box_set,
            c.complete_season, c.category, c.file_size, c.compressed, c.tmdb_id as disk_tmdb_id,
            p.id as purchase_id, p.purchase_date, p.cost, p.store, p.condition, p.notes
        from dvd_items c left join media_purchases p on p.dvd_item_id = c.id""",
    "media_title_spend": f"""
        select t.id as media_title_id, cast(coalesce(sum(p.cost), 0) as {SUMS}) as total
        from media_titles t left join dvd_items c on c.media_title_id = t.id
        left join media_purchases p on p.dvd_item_id = c.id group by t.id""",
    "media_search_location": "select * from media_base where location_label ilike '%shelf 1%'",
    "media_search_name": """
        select * from media_base where title ilike '%CUSTOMER#00000012%'
            or season_name ilike '%CUSTOMER#00000012%'""",
    "media_search_sorted":
        "select * from media_base where title ilike '%urgent%' or season_name ilike '%urgent%'",
    "media_shelf": """
        select *, (select count(*) from media_base where location_label ilike '%Shelf 7%')
            as shelf_count from media_base where location_label ilike '%Shelf 7%'""",
    "game_base": "select * from game_base",
    "game_recent": """
        select * from game_base where purchase_date is not null
        order by purchase_date desc, pi_id limit 10""",
    "game_count": "select count(*) as count from game_base",
    "game_count_by_genre": "select genre, count(genre) as count from game_base group by genre",
    "game_count_by_platform":
        "select platform, count(platform) as count from game_base group by platform",
    "game_cost_by_platform":
        "select platform, cast(sum(cost) as decimal(18,2)) as sum from game_base group by platform",
    "game_cost_by_store":
        "select store, cast(sum(cost) as decimal(18,2)) as sum from game_purchases group by store",
    "game_location_count":
        "select count(*) as count from game_base where location_label ilike '%shelf 1%'",
    "game_genres": "select distinct genre from game_titles where genre <> ''",
    "game_title_detail": """
        select c.game_title_id as title_id, c.id as game_copy_id, c.platform, c.edition, c.region,
            c.condition as copy_condition, c.location_label, c.notes as copy_notes,
            p.id as purchase_id, p.purchase_date, p.cost, p.store, p.condition, p.notes
        from game_copies c left join game_purchases p on p.game_copy_id = c.id""",
    "game_title_spend": f"""
        select t.id as game_title_id, cast(coalesce(sum(p.cost), 0) as {SUMS}) as total
        from game_titles t left join game_copies c on c.game_title_id = t.id
        left join game_purchases p on p.game_copy_id = c.id group by t.id""",
    "game_search_location": "select * from game_base where location_label ilike '%shelf 1%'",
    "game_search_name":
        "select * from game_base where title ilike '%br_nd#1%' or franchise ilike '%br_nd#1%'",
    "game_search_sorted": """
        select * from game_base where (title ilike '%ring%' or franchise ilike '%ring%')
            and location_label ilike '%Shelf 4%'""",
    "game_library": """
        select game_title_id, game_copy_id, pi_id as purchase_id, title, franchise, genre,
            developer, publisher, release_year, rawg_id, platform, edition, region,
            copy_condition, location_label, purchase_date, cost, store, condition, notes
        from game_base""",
    "lookup_titles": """
        select * from media_titles where id in
            (select o_custkey from orders where o_orderpriority = '1-URGENT')""",
    "lookup_games": """
        select * from game_titles where id in
            (select l_partkey from lineitem where l_returnflag = 'R')""",
    "media_dup_check": _dup_check(
        "select substring(s_name, 10) as probe from supplier", "media_titles", "dvd_items",
        "media_title_id", "id, title, type, genre, tmdb_id, total_seasons, complete_collection",
        "disk_count"),
    "game_dup_check": _dup_check(
        "select case p_partkey%4 when 0 then upper(p_name) when 1 then replace(p_name, ' ', '%')"
        " when 2 then left(p_name, 2) else replace(p_name, 'e', '_') end as probe from part",
        "game_titles", "game_copies", "game_title_id",
        "id, title, franchise, genre, rawg_id, developer", "copy_count"),
    "media_posters": """
        select media_title_id, title, type, tmdb_id from (
            select distinct on (t.id) t.id as media_title_id, t.title, t.type,
                coalesce(c.tmdb_id, t.tmdb_id) as tmdb_id
            from media_titles t join dvd_items c on c.media_title_id = t.id
            where coalesce(c.tmdb_id, t.tmdb_id) is not null order by t.id, c.id)
        order by md5(media_title_id || '7'), media_title_id limit 30""",
    "game_covers": """
        select id as game_title_id, title, rawg_id from game_titles
        where rawg_id is not null and rawg_id <> '' order by md5(id || '7'), id limit 30""",
    "poster_urls": """
        select id, 'https://www.themoviedb.org/' || case when type = 'movie' then 'movie' else 'tv'
            end || '/' || tmdb_id as url from media_titles where tmdb_id is not null""",
    # Ledger
    "item_ledger": f"select {LEDGER} from ledger_rows",
    "item_ledger_base": f"select {LEDGER_BASE} from ledger_rows",
    "ledger_search_name": f"""
        select {LEDGER_BASE} from ledger_rows where name ilike '%S1%' or set_code ilike '%S1%'
            or collector_number ilike '%S1%'""",
    "ledger_filter_game_status":
        f"select {LEDGER_BASE} from ledger_rows where game = 'weiss' and status = 'keep'",
    "ledger_collection": f"select {LEDGER_BASE} from ledger_rows",
    "card_detail": f"select {DETAIL} from ledger_rows",
    "lookup_cards": f"""
        select {DETAIL} from ledger_rows
        where item_id in (select item_id from sale where channel = 'lgs')""",
    "lookup_boxes": """
        select acquisition_id, purchase_date, description, game, product_type, set_code, language,
            packs_total, packs_opened, status, source, channel, total_cost from acquisition
        where acquisition_id in (select acquisition_id from item where grader is not null)""",
    "box_items": f"""
        select {', '.join('r.' + c.strip() for c in LEDGER_BASE.split(','))}, c.tier
        from ledger_rows r left join candidates c on c.item_id = r.item_id""",
    "box_pl": _box_pl("sale", "s.net_proceeds"),
    "box_pl_sorted": _box_pl("sale", "s.net_proceeds"),
    "box_pl_dedupe": _box_pl(
        "(select item_id, sum(net_proceeds) as net from sale group by item_id)", "s.net"),
    "portfolio": f"""
        select (select cast(coalesce(sum(total_cost), 0) as {SUMS}) from acquisition)
                as total_invested,
            (select cast(coalesce(sum(net_proceeds), 0) as {SUMS}) from sale)
                as total_realized_net,
            (select cast(coalesce(sum(s.net_proceeds - (i.cost_basis + i.grading_total)), 0)
                as {SUMS}) from sale s join item i on i.item_id = s.item_id) as realized_profit,
            (select cast(coalesce(sum(market_value), 0) as {SUMS}) from item
                where status in {OWNED}) as unsold_market_value,
            (select cast(coalesce(sum(market_value - (cost_basis + grading_total)), 0) as {SUMS})
                from item where status in {OWNED} and market_value is not null)
                as unrealized_profit""",
    "ledger_games": """
        select distinct coalesce(i.game, a.game) as game from item i
        join acquisition a on a.acquisition_id = i.acquisition_id
        where coalesce(i.game, a.game) is not null""",
    "ledger_statuses": "select distinct status from item",
    "appendable_boxes": """
        select acquisition_id, description, packs_opened, packs_total, status from acquisition
        where status in ('sealed', 'partial')""",
    "ledger_posters": """
        select item_id, name, set_code, image_url, market_value from item
        where image_url is not null and image_url <> ''
        order by md5(item_id || '7'), item_id limit 24""",
    "ledger_location": """
        select item_id, name, set_code, condition, status, storage_location from item
        where storage_location ilike '%shelf 1%'""",
    "locate": """
        select 'movies' as collection, dvd_id as entry_id, title, location_label as location,
            purchase_date, cost, null as platform, null as status, genre, pi_id
            from media_base where location_label ilike '%shelf 1%'
        union all select 'cards', item_id, name, storage_location, null, null, null, status, null,
            null from item where storage_location ilike '%shelf 1%'
        union all select 'games', game_copy_id, title, location_label, purchase_date, cost,
            platform, null, genre, pi_id from game_base where location_label ilike '%shelf 1%'""",
    "locate_movies": """
        select 'movies' as collection, dvd_id as entry_id, title, location_label as location,
            genre, pi_id from media_base where location_label ilike '%shelf 1%'""",
    "locate_cards": """
        select 'cards' as collection, item_id as entry_id, name as title,
            storage_location as location, status
        from item where storage_location ilike '%shelf 1%'""",
    "locate_games": """
        select 'games' as collection, game_copy_id as entry_id, title, location_label as location,
            platform, pi_id from game_base where location_label ilike '%shelf 1%'""",
    "locate_counts": """
        select movies, cards, games, movies + cards + games as total from (select
            (select count(*) from media_base where location_label ilike '%shelf 1%') as movies,
            (select count(*) from item where storage_location ilike '%shelf 1%') as cards,
            (select count(*) from game_base where location_label ilike '%shelf 1%') as games)""",
    # Allocation and grading
    "allocate_cost": "select item_id, acquisition_id, cost_basis from basis",
    "box_median": "select * from medians",
    "grade_candidates": "select * from candidates",
    "grade_candidates_v1": "select * exclude (median_value, tier) from candidates where tier = 'grade'",
    "grade_reasons": """
        select item_id, tier, reason, round(multiple, 1) as median_multiple from reasons""",
    "grading_scorecard": """
        select i.item_id, i.name, i.grader, i.grade, i.cost_basis as card_basis,
            i.grading_total as grading_spend, i.cost_basis + i.grading_total as total_basis,
            s.net_proceeds,
            s.net_proceeds - (i.cost_basis + i.grading_total) as profit_after_grading
        from item i join sale s on s.item_id = i.item_id where i.grader is not null""",
    "grading_history": """
        select * exclude (sale_id) from (select a.query_name, g.*, cast(row_number() over (
            partition by a.query_name order by g.sale_date desc nulls last, g.item_id desc,
                g.sale_id) as integer) as position
        from (select distinct case p_partkey%5 when 0 then upper(p_name)
                when 1 then replace(p_name, 'a', '_') when 2 then left(p_name, 4)||'%'
                when 3 then '%'||right(p_name, 5) else p_name end as query_name from part) a
        join graded_copies g on g.name ilike a.query_name) where position <= 5""",
    "grading_report": """
        select r.item_id, r.name, r.tier, r.reason, r.est_upside,
            cast(coalesce(len(h.items), 0) as integer) as n_history, h.items[1] as latest_item,
            h.profits[1] as latest_profit,
            coalesce(list_aggregate(h.items, 'string_agg', ','), '') as history_items
        from reasons r left join (select name, list(item_id order by position) as items,
                list(profit order by position) as profits
            from (select a.name, g.item_id, g.profit_after_grading as profit, row_number() over (
                    partition by a.name order by g.sale_date desc nulls last, g.item_id desc,
                        g.sale_id) as position
                from (select distinct name from candidates where tier = 'grade') a
                join graded_copies g on lower(g.name) = lower(a.name)) where position <= 5
            group by name) h on h.name = r.name and r.tier = 'grade'""",
    # Intake
    "intake_normalize": "select * exclude (l_suppkey) from normal",
    "intake_summary": f"""
        select * exclude (n_games), n_games > 1 as mixed from (
            select batch_id, cast(sum(quantity) as bigint) as n_cards,
            arg_min(set_code, row_pos) filter (coalesce(set_code, '') <> '') as set_code,
            string_agg(distinct game, ',' order by game) as games,
            cast(coalesce(sum(market_value * quantity), 0) as {SUMS}) as total_value,
            cast(coalesce(sum(paid * quantity), 0) as {SUMS}) as sum_paid,
            bool_or(paid is not null) as paid_seen, bool_or(has_paid_column) as has_paid_column,
            count(distinct game) as n_games
        from normal group by batch_id)""",
    "intake_expand_qty": """
        select batch_id, row_pos, cast(unnest(range(quantity)) as integer) as copy_no, name, variant
        from normal""",
    "scalar_clean_number": f"""
        select line_id, {number('text')} as number, {amount('text')} as amount,
            coalesce({amount('text')}, 0) as amount_or_zero, {whole('text')} as whole,
            case when {whole('text')} > 0 then {whole('text')} end as positive,
            {copies('text')} as quantity
        from (select line_id, case line_id%8 when 0 then '' when 1 then ' 12.345 ' when 2 then '-3'
            when 3 then '$4' when 4 then cast(l_partkey as varchar) when 5 then '1e2'
            when 6 then '2.9' end as text from line)""",
    "scalar_strip_rarity": """
        select row_pos, game, code as collector_number,
            case when game = 'weiss' then split_part(code, '-', 1) else nullif(set_name, '') end
                as set_code, old_code as legacy_number, split_part(old_code, '-', 1) as legacy_set
        from export_code""",
    "scalar_variant_condition": f"""
        select row_pos, variant, condition_code as condition, {copies('quantity')} as quantity
        from export_code""",
    "intake_acquisition": "select * exclude (n_cards) from planned",
    "singles_basis": "select batch_id, card_index, cost_basis, used_fallback from single",
    "import_sealed": f"""
        select item_id, batch_id, card_index, acquisition_id, name, game, set_code, language,
            condition, settled as cost_basis, market_value, status
        from ({_allocated('''select b.first_item + c.card_index + 1 as item_id, c.batch_id,
            c.card_index, b.acquisition_id, c.name, c.game, c.set_code, b.language, c.condition,
            c.market_value, c.market_value as own_value, 'inventory' as status, b.total_cost,
            b.packs_total, b.packs_opened from card c join sealed_box b
            on b.batch_id = c.batch_id''')})""",
    "import_sealed_boxes": f"select {BOX_COLUMNS} from sealed_box b",
    "import_singles": _imported("single_box", "single", "c.cost_basis"),
    "import_singles_boxes": f"""
        select {BOX_COLUMNS.replace('b.total_cost', 'cast(b.purchase_price + b.tax + b.shipping_in + b.other_fees as decimal(12,2)) as total_cost')}
        from (select b.* exclude (product_type, packs_total, cards_per_pack, packs_opened, status,
                purchase_price), 'single' as product_type, cast(null as integer) as packs_total,
                cast(null as integer) as cards_per_pack, cast(null as integer) as packs_opened,
                'opened' as status, (select cast(coalesce(sum(cost_basis), 0) as decimal(12,2))
                    from single s where s.batch_id = b.batch_id) as purchase_price
            from single_box b) b""",
    "import_append": f"""
        select item_id, acquisition_id, name, settled as cost_basis, status
        from ({_allocated('''select i.*, market_value_at_open as own_value, b.total_cost,
            b.packs_total, b.packs_opened from append_item i join append_box b
            on b.acquisition_id = i.acquisition_id''')})""",
    "import_append_boxes":
        "select acquisition_id, packs_total, packs_opened, status from append_box",
    "import_rejects": "select * from reject",
    "import_row_rejects": """
        select batch_id, case when bool_or(condition not in ('NM', 'LP', 'MP', 'HP', 'DMG', 'sealed'))
            then 'condition' else 'game' end || ' is not an allowed value' as reason
        from import_row where batch_id in (select batch_id from broken_row) group by batch_id""",
    "import_preview": f"""
        select p.batch_id, b.mode, p.n_cards, b.total_value,
            case when b.mode <> 'append' then p.game end as game,
            case when b.mode = 'sealed' then p.total_cost end as total_cost,
            case when b.mode = 'sealed' and p.packs_total is not null then
                    coalesce(p.packs_opened, 0) || ' / ' || p.packs_total || ' → ' || p.status
                when b.mode = 'append' then coalesce(a.packs_opened, 0) || ' / ' ||
                    coalesce(cast(a.packs_total as varchar), '?') || ' packs · ' || a.status end
                as packs,
            case when b.mode = 'singles' then not b.paid_seen end as warn_paid,
            case when p.n_cards = 0 and b.intake <> 'manual' then 'No item rows parsed — check the CSV format (expected a ''Product Name'' column).' else '' end as warnings
        from planned p join batch b on b.batch_id = p.batch_id
        left join acquisition a on a.acquisition_id = try_cast(b.acquisition_id as bigint)""",
    "import_legacy": f"""
        select item_id, batch_id, card_index, acquisition_id, name, game, set_code, language,
            condition, case when basis = 'as_paid' then paid_basis else settled end as cost_basis,
            market_value, status
        from ({_allocated('select *, market_value as own_value from old_item')})""",
    "import_legacy_boxes": f"select {BOX_COLUMNS} from old_box b",
    "import_legacy_rejects": "select * from old_reject",
    "assign_keys": """
        select p_partkey, (select max(o_orderkey) from orders) + row_number() over (
            order by md5(cast(p_partkey as varchar)), p_partkey) as acquisition_id from part""",
    # Changes and quality
    "apply_edits": _changed("('edit')"),
    "apply_gradings": _changed("('grade')"),
    "apply_locations": f"""
        select i.item_id, i.acquisition_id, c.storage_location
        from ({_changed("('location')")}) c join item i on i.item_id = c.item_id""",
    "apply_changes": _changed("('edit', 'sale', 'grade', 'location')"),
    "apply_sales": """
        select * exclude (created_at, notes) from sale
        union all select (select max(sale_id) from sale) + row_number() over (
                order by md5(cast(event_id as varchar)), event_id),
            item_id, cast(f_sale_date as date), nullif(f_channel, ''),
            cast(f_gross_price as decimal(12,2)), 0, cast(f_marketplace_fee as decimal(12,2)), 0,
            0, 0, 0,
            cast(cast(f_gross_price as decimal(12,2)) - cast(f_marketplace_fee as decimal(12,2))
                as decimal(12,2))
        from good_event where kind = 'sale' and item_id <= (select count(*) from lineitem)""",
    "change_rejects": "select * from bad_event",
    "backfill_game": """
        select i.item_id, coalesce(i.game, case when a.game <> 'mixed' then a.game end) as game
        from item i join acquisition a on a.acquisition_id = i.acquisition_id""",
    "evolve_schema": """
        select item_id, name, cast(null as varchar) as game,
            cast(null as varchar) as tcgplayer_product_id, cast(null as varchar) as image_url,
            false as grade_candidate, cast(null as decimal(12,2)) as graded_value_est from item""",
    "cascade_delete": """
        select 'acquisition' as table_name, acquisition_id as key from acquisition
            where status <> 'resold_sealed'
        union all select 'item', i.item_id from item i join acquisition a
            on a.acquisition_id = i.acquisition_id where a.status <> 'resold_sealed'
        union all select 'sale', s.sale_id from sale s join item i on i.item_id = s.item_id
            join acquisition a on a.acquisition_id = i.acquisition_id
            where a.status <> 'resold_sealed'""",
    "violations": f"""
        select 'acquisition' as table_name, acquisition_id as key, unnest(list_filter([
            case when description is null then 'description is required' end,
            case when purchase_price < 0 then 'purchase_price is negative' end,
            case when game not in ('mtg', 'weiss', 'pokemon', 'other', 'mixed')
                then 'game is not an allowed value' end], lambda x: x is not null)) as rule
            from ({{boxes}})
        union all select 'item', b.first_item + c.card_index + 1, unnest(list_filter([
            case when c.condition not in ('NM', 'LP', 'MP', 'HP', 'DMG', 'sealed')
                then 'condition is not an allowed value' end,
            case when c.game not in ('mtg', 'weiss', 'pokemon', 'other')
                then 'game is not an allowed value' end], lambda x: x is not null))
        from card c join ({{boxes}}) b on b.batch_id = c.batch_id""".replace(
        "{boxes}", RELATIONS["sealed_box"].replace("from accepted", "from manifest")),
    "orphans": """
        select 'item' as table_name, i.item_id as key, i.acquisition_id as reference
            from item i join acquisition a on a.acquisition_id = i.acquisition_id
            where a.status = 'sealed' and i.grader is null
        union all select 'sale', s.sale_id, s.item_id from sale s
            join item i on i.item_id = s.item_id where i.grader is not null""",
    # Saved service answers
    "metadata_media_hits": "select * from media_hit",
    "metadata_media_genre": """
        select h.query_id, h.position, h.tmdb_id, n.name as genre from media_hit h
        left join genre n on n.media_type = h.media_type and n.id = h.first_genre_id""",
    "metadata_game_hits": f"""
        select query_id, cast(i as integer) as position, id as rawg_id, coalesce(name, '') as title,
            coalesce(left(released, 4), '') as year, coalesce(genre, '') as genre,
            coalesce(background_image, '') as cover
        from ({_results("part", "p_partkey", m.GAME_RESULTS, {**m.GAME_RESULT, "genre": m.GAME_GENRE})})
        where i <= 5""",
    "metadata_game_companies": f"""
        select p_partkey as query_id, {m.DEVELOPER} as developer, {m.PUBLISHER} as publisher
        from part""",
    "metadata_poster_path": f"""
        select c_custkey as query_id, case when c_custkey%8=0 then 'Movie not found.'
            when coalesce(path, '') = '' then 'Poster not available for this movie.'
            else 'https://image.tmdb.org/t/p/w500' || path end as poster
        from (select *, {m.MEDIA_RESULT["poster_path"]} as path
            from (select *, 1 as i from customer))""",
}
RELATIONS["media_hit"] = f"""
    select query_id, cast(row_number() over (partition by query_id order by i) as integer)
            as position,
        id as tmdb_id, coalesce(nullif(title, ''), nullif(name, ''), '') as title,
        left(coalesce(release_date, first_air_date, ''), 4) as year,
        case when media_type = 'movie' then 'movie' else 'tv_show' end as type, media_type,
        case when coalesce(poster_path, '') = '' then ''
            else 'https://image.tmdb.org/t/p/w92' || poster_path end as poster,
        first_genre as first_genre_id
    from ({_results("customer", "c_custkey", m.MEDIA_RESULTS,
                    {**m.MEDIA_RESULT, "first_genre": m.FIRST_GENRE})})
    where media_type in ('movie', 'tv') qualify position <= 5"""
RELATIONS["genre"] = f"select {_columns(m.NATION_GENRES)} from nation"


def _positions(source: str, keys: str, sorts: dict[str, str]) -> str:
    """Every row's place under each order; equal rows in the order of their keys."""
    last = ", ".join(f"{key} nulls last" for key in keys.split(", "))
    return " union all ".join(
        f"select '{name}' as sort, row_number() over (order by {order}, {last}) as position, {keys}"
        f" from {source}" for name, order in sorts.items()
    )


CATALOGUE_SORTS = {
    "title": "title nulls last", "acquired_desc": "purchase_date desc nulls last, title nulls last",
    "acquired_asc": "purchase_date nulls last, title nulls last", "cost_desc": "cost desc nulls last",
    "cost_asc": "cost nulls last",
}
QUERIES["media_sorted_all"] = _positions(
    "media_base", "dvd_id, pi_id", {**CATALOGUE_SORTS, "genre": "genre nulls last, title nulls last"}
)
QUERIES["game_sorted_all"] = _positions("game_base", "game_copy_id, pi_id", {
    **CATALOGUE_SORTS, "platform": "platform nulls last, title nulls last",
    "year_desc": "release_year desc nulls last, title nulls last",
})
QUERIES["ledger_sorted_all"] = _positions("""(
    select i.item_id, s.sale_id, i.name, i.market_value, a.purchase_date, i.status,
        i.cost_basis + i.grading_total as total_basis
    from item i join acquisition a on a.acquisition_id = i.acquisition_id
    left join sale s on s.item_id = i.item_id) x""", "item_id, sale_id", {
    "name": "name nulls last", "value_desc": "market_value desc nulls last",
    "value_asc": "market_value nulls last",
    "acquired_desc": "purchase_date desc nulls last, name nulls last",
    "acquired_asc": "purchase_date nulls last, name nulls last",
    "basis_desc": "total_basis desc nulls last", "status": "status nulls last, name nulls last",
})
QUERIES["boxes_sorted_all"] = " union all ".join(
    f"""select '{name}' as list, row_number() over (order by purchase_date desc nulls first,
        acquisition_id desc) as position, acquisition_id from acquisition where {keep}"""
    for name, keep in (("all", "true"), ("appendable", "status in ('sealed', 'partial')"))
)
QUERIES["import_legacy_append"] = f"""
    select item_id, acquisition_id, name, settled as cost_basis, status
        from ({_allocated('''select i.*, market_value_at_open as own_value, b.total_cost,
            b.packs_total, b.packs_opened from la_item i join la_box b
            on b.acquisition_id = i.acquisition_id where i.acquisition_id in
            (select acquisition_id from la_batch where basis = 'allocate')''')}) x
    union all select item_id, acquisition_id, name, held_basis, status from la_item
        where acquisition_id not in (select acquisition_id from la_batch where basis = 'allocate')"""
# Stored tables give what the tables they were made from give; cards added after others come behind them.
QUERIES["box_pl_stored"] = QUERIES["box_pl"]
QUERIES["merge_changes"] = QUERIES["apply_changes"]
QUERIES["merge_sales"] = QUERIES["apply_sales"]
QUERIES["sink_roundtrip"] = f"""
    select item_id, acquisition_id, name, cost_basis, status from item
        where acquisition_id not in (select acquisition_id from append_batch)
    union all select item_id, acquisition_id, name, cost_basis, status
        from ({QUERIES["import_sealed"]}) x
    union all select case when item_id <= (select count(*) from lineitem) then item_id
            else item_id + (select count(*) from ({QUERIES["import_sealed"]}) y) end as item_id,
        acquisition_id, name, cost_basis, status from ({QUERIES["import_append"]}) z"""


QUERIES["box_pl_incremental"] = _box_pl(
    f"(select item_id, net_proceeds from ({QUERIES['apply_sales']}) y)", "s.net_proceeds"
).replace("left join item i on", f"""left join (
    select c.item_id, o.acquisition_id, c.grading_total, o.market_value_at_open, c.market_value, c.status
    from ({QUERIES['apply_changes']}) c join item o on o.item_id = c.item_id) i on""")


def oracle(key: str) -> str:
    """One statement: the relations a query needs, then the query."""
    needed, texts = set(), [QUERIES[key]]
    while texts:
        words = set("".join(c if c.isalnum() or c == "_" else " " for c in texts.pop()).split())
        for name in RELATIONS:
            if name in words and name not in needed:
                needed.add(name)
                texts.append(RELATIONS[name])
    order = [name for name in RELATIONS if name in needed]
    relations = ",\n".join(f"{name} as ({RELATIONS[name]})" for name in order)
    return f"with {relations}\n{QUERIES[key]}" if order else QUERIES[key]
