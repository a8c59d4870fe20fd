"""Declared schemas of the raw inputs; every field is nullable."""

WEB_LOG = """event_id string, event_type string, timestamp string, session_id string,
user struct<user_id:string,first_name:string,last_name:string,email:string,authenticated:boolean,registration_date:string,user_segment:string,phone:string,favorite_category:string>,
device struct<type:string,browser:string,os:string,resolution:string,operator:string,is_mobile:boolean>,
location struct<country:string,city:string,region:string,ip_address:string,language:string>,
marketing struct<source:string,medium:string,campaign:string,channel:string,campaign_id:string>,
page struct<url:string,referrer:string,title:string,visit_duration:string>,
product struct<product_id:string,name:string,price:double,category:string,url:string,quantity:int>,
cart struct<total:double>, purchase struct<order_id:string,total:double,payment_method:string,currency:string>,
search struct<query:string,results_count:int>, filter struct<category:string,price_range:string,sort_by:string,rating:string>"""

CUSTOMER = """customer_id string, first_name string, last_name string, email string, phone string, city string, region string, address string,
registration_date timestamp, first_purchase_date timestamp, last_purchase_date timestamp, total_orders int, lifetime_value double,
favorite_category string, skin_type string, skin_concerns string, preferred_ingredients string, allergies string, age string, gender string,
is_subscribed boolean, email_engagement string, acquisition_source string"""

ORDER = """order_id string, customer_id string, order_date timestamp, order_total double, discount_code string, discount_amount double,
final_total double, shipping_cost double, payment_method string, order_status string, utm_source string, utm_medium string, utm_campaign string,
items string, season string, city string, phone string"""

ITEMS = "array<struct<product_name:string,category:string,price:double,quantity:int,item_total:double>>"

_AD = """impressions int, clicks int, ctr double, avg_cpc double, cost double, conversions int, conversion_rate double, conversion_value double,
target_audience string, category string, campaign_day int, campaign_duration int"""
GOOGLE_ADS = f"date string, platform string, campaign_id string, campaign_name string, ad_type string, {_AD}, keywords string"
SOCIAL_ADS = f"date string, platform string, campaign_id string, campaign_name string, ad_type string, content_theme string, {_AD}, engagements int, likes int, comments int, shares int"
INFLUENCER = """date string, campaign_id string, campaign_name string, influencer_id string, influencer_name string, platform string, content_type string,
impressions int, engagements int, engagement_rate double, clicks int, ctr double, conversions int, conversion_rate double, conversion_value double,
fee double, duration int, promo_code string, category string, campaign_day int, is_post_day boolean"""
ALL_PLATFORMS = """date string, platform string, campaign_id string, campaign_name string, ad_type string, impressions int, clicks int, cost double,
conversions int, conversion_value double, target_audience string, category string"""

#: dataset -> (file name pattern, schema)
CSV_DATASETS = {
    "customers": ("*customers*", CUSTOMER), "orders": ("*orders*", ORDER), "google_ads": ("*google_ads*", GOOGLE_ADS),
    "social_ads": ("*social_ads*", SOCIAL_ADS), "influencer": ("*influencer_data*", INFLUENCER), "all_platforms": ("*all_platforms*", ALL_PLATFORMS),
}
