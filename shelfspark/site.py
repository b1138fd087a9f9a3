"""What a retail site's pages look like: hosts as parameters, markup markers as fixed values."""

from __future__ import annotations

from dataclasses import dataclass

# Attributes, class tokens and patterns the page readers look for.
CARD_WRAPPER = "@web/site-top-of-funnel/ProductCardWrapper"
CARD_TITLE = "@web/ProductCard/title"
CARD_BRAND = "@web/ProductCard/ProductCardBrandAndRibbonMessage/brand"
CARD_SWATCHES = "@web/ProductCard/ProductCardSwatches"
CARD_PICTURE = "@web/ProductCard/ProductCardImage/primary"
CARD_FOCUS = "_product_card"
CURRENT_PRICE = "current-price"
COMPARISON_PRICE = "comparison-price"
REGULAR_PRICE_PATTERN = "original-price|regular-price"
RATING_BOX_CLASS = "styles_ndsRatingStars__uEZcs"
RATING_COUNT_CLASS = "styles_ratingCount__QDWQY"
RIBBON_CLASS = "brandAndRibbonWrapper"
DETAIL_TITLE = "product-title"
DETAIL_PRICE = "product-price"
DETAIL_REGULAR_PRICE = "product-regular-price"
BREADCRUMB_MODULE = "ProductDetailBreadcrumbs"
BREADCRUMB_LABEL = "Breadcrumbs"
BREADCRUMB_NAV = "@web/Breadcrumbs/BreadcrumbNav"
BREADCRUMB_LINK = "@web/Breadcrumbs/BreadcrumbLink"
GALLERY_LABEL = "Image gallery"
GALLERY_ITEM = "image-gallery-item"
HIGHLIGHTS_ID = "PdpHighlightsSection"
SPEC_BOX = "item-details-specifications"
SPEC_SECTION = "ProductDetailCollapsible-Specifications"
SPEC_CONTENT = "collapsibleContentDiv"
SPEC_DISCLAIMER = "itemDetailsTabMarketplaceMessage"
SPEC_MARKERS = ("Dimensions (Overall):", "TCIN:")
SELLER_LINK = "targetPlusExtraInfoSection"
CAROUSEL_CLASS = "styles_ndsCarousel__yMTV9"
CHIP_CLASS = "styles_ndsChip__lwwR_"
VARIATION = "@web/VariationComponent"
NEXT_PAGE_LABEL = "Go to next page"
PAGE_OFFSET_PARAM = "Nao"
PAGE_SIZE = 24
PAGE_JSON_ID = "__NEXT_DATA__"
IMAGE_CAP_ADV = 15
IMAGE_CAP_CMP = 10

# Key paths tried in the JSON a page embeds.
_PRODUCT_IN_QUERY = (
    "props", "pageProps", "dehydratedState", "queries", "0", "state", "data", "product",
)
_PRODUCT_IN_PROPS = ("props", "pageProps", "product")
_STATISTICS = (*_PRODUCT_IN_QUERY, "ratings_and_reviews", "statistics", "rating")
JSON_TITLE = ((*_PRODUCT_IN_QUERY, "item", "product_description", "title"), (*_PRODUCT_IN_PROPS, "title"))
JSON_PRICE = (
    (*_PRODUCT_IN_QUERY, "price", "formatted_current_price"),
    (*_PRODUCT_IN_PROPS, "price", "formatted_current_price"),
)
JSON_RATING = ((*_STATISTICS, "average"),)
JSON_RATING_COUNT = ((*_STATISTICS, "count"),)


@dataclass(frozen=True)
class SiteProfile:
    """Hosts and name of the shop whose pages are read."""

    host: str = "shop.example"
    image_host: str = "images.shop.example"
    store_name: str = "shop"
    category_path: str = "/c/category"

    @property
    def base(self) -> str:
        return f"https://{self.host}"

    @property
    def category_url(self) -> str:
        return self.base + self.category_path
